"""Atoms of structures with their models, from PDB and mmCIF text, in one schema.

Spark reads the files, one a row, so any store that Spark reaches will do; the
size of a structure file bounds a row.  mmCIF values can span lines, so a
small tokenizer runs on each file and hands its atoms on in batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import pdb_columns

ATOMS = "file string, model int, atom_id long, atom_name string, alt_loc string, residue_name string, chain string, residue string, x double, y double, z double, occupancy double, b_factor double, element string, hetatm boolean"
#: Atoms of a batch.
BATCH = 20_000
#: Items of the atom table by column; of several the first that a file has is taken. Fixed values of the format.
ITEMS = {
    "model": ["pdbx_PDB_model_num"],
    "atom_id": ["id"],
    "atom_name": ["auth_atom_id", "label_atom_id"],
    "alt_loc": ["label_alt_id"],
    "residue_name": ["auth_comp_id", "label_comp_id"],
    "chain": ["auth_asym_id", "label_asym_id"],
    "residue": ["auth_seq_id", "label_seq_id"],
    "insertion": ["pdbx_PDB_ins_code"],
    "x": ["Cartn_x"],
    "y": ["Cartn_y"],
    "z": ["Cartn_z"],
    "occupancy": ["occupancy"],
    "b_factor": ["B_iso_or_equiv"],
    "element": ["type_symbol"],
    "hetatm": ["group_PDB"],
}
_TOKEN = re.compile(r"""'((?:[^'\n]|'(?=\S))*)'(?=\s|$)|"((?:[^"\n]|"(?=\S))*)"(?=\s|$)|(\#.*)|(\S+)""", re.M)


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Values of CIF text in order, and whether each was quoted: then it is no keyword, and ``.`` or ``?`` no null."""
    at, n = 0, len(text)
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end
        if text.startswith(";", at):
            close = text.find("\n;", at)
            if close < 0:
                raise ValueError("a text block is not closed")
            yield text[at + 1 : close], True
            at = close + 2
            line_end = text.find("\n", at)
            line_end = n if line_end < 0 else line_end
            yield from _of_line(text[at:line_end])
            at = line_end + 1
            continue
        yield from _of_line(text[at:end].rstrip("\r"))
        at = end + 1


def _of_line(line: str) -> Iterator[tuple[str, bool]]:
    for m in _TOKEN.finditer(line):
        if m[3] is not None:
            return
        if m[4] is not None:
            yield m[4], False
        else:
            yield (m[1] if m[1] is not None else m[2]), True


def atom_rows(text: str) -> Iterator[dict[str, str | None]]:
    """The atom table's rows by item name, whether it is a loop or single items; nulls are None."""
    names: list[str] = []
    values: list[str | None] = []
    single: dict[str, str | None] = {}
    in_names = in_loop = False
    item = None
    for value, quoted in tokens(text):
        word = "" if quoted else value.lower()
        if word == "loop_" or word.startswith(("data_", "save_")) or (word.startswith("_") and not in_names):
            if values:
                raise ValueError("the last row of the atom table is not whole")
            in_loop = in_names = word == "loop_"
            names, item = [], None
            if word.startswith("_"):
                item = value
            continue
        if word.startswith("_"):
            names.append(value)
            continue
        in_names = False
        found = None if not quoted and value in (".", "?") else value
        if in_loop and names and names[0].lower().startswith("_atom_site."):
            values.append(found)
            if len(values) == len(names):
                yield {k.split(".", 1)[1]: v for k, v in zip(names, values)}
                values = []
        elif item is not None and item.lower().startswith("_atom_site."):
            single[item.split(".", 1)[1]] = found
            item = None
    if values:
        raise ValueError("the last row of the atom table is not whole")
    if single:
        yield single


def _typed(row: dict[str, str | None], file: str) -> tuple:
    got = {c: next((row[i] for i in items if row.get(i) is not None), None) for c, items in ITEMS.items()}
    number = lambda c: None if got[c] is None else float(got[c])
    residue = None if got["residue"] is None else got["residue"] + (got["insertion"] or "")
    model = int(got["model"] or 1)
    return file, model, int(got["atom_id"]), got["atom_name"], got["alt_loc"] or "", got["residue_name"], got["chain"], residue, *(number(c) for c in ("x", "y", "z", "occupancy", "b_factor")), got["element"], got["hetatm"] == "HETATM"


def read_mmcif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms with the author's names and numbers; a residue id ends in its insertion code, if it has one."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ATOMS.split(", ")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def parse(batches):
        for batch in batches:
            for file, text in zip(batch.column(0), batch.column(1)):
                rows = []
                for row in atom_rows(text.as_py()):
                    rows.append(_typed(row, file.as_py()))
                    if len(rows) == BATCH:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value").mapInArrow(parse, ATOMS)


def read_pdb_models(spark: SparkSession, path: str) -> DataFrame:
    """``read_pdb_atoms`` with ``model``, 1 in files without models."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^MODEL(?=\s)")).alias("k", "part"))
    model = F.when(F.col("k") == 0, F.lit(1)).otherwise(F.regexp_extract("part", r"^\s+(\d+)", 1).cast("int"))
    lines = files.select("file", model.alias("model"), F.explode(F.split("part", "\r?\n")).alias("value"))
    return pdb_columns(lines, F.col("file"), F.col("model"))


def of_model(atoms: DataFrame, model: int = 1, alt_loc: str | None = None) -> DataFrame:
    """Atoms of one model of each file; with ``alt_loc``, of alternate locations only that one (atoms without one stay)."""
    found = atoms.where(F.col("model") == model)
    return found if alt_loc is None else found.where(F.col("alt_loc").isin("", alt_loc))
