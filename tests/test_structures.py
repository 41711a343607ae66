"""PDB and mmCIF text of one structure: equal atoms."""

import pytest
from pyspark.sql import functions as F

from sitewise.sources import readers as R
from sitewise.sources import structures as S

#: serial, name, alternate location, residue, chain, number, insertion code, x, y, z, occupancy, temperature, element, hetero, model
ATOMS = [
    (1, "N", "", "MET", "A", "1", "", 1.5, 2.25, -3.125, 1.0, 20.5, "N", False, 1),
    (2, "CA", "A", "MET", "A", "1", "", 2.0, 2.0, 2.0, 0.6, 21.0, "C", False, 1),
    (3, "CA", "B", "MET", "A", "1", "", 2.5, 2.0, 2.0, 0.4, 22.0, "C", False, 1),
    (4, "CA", "", "GLY", "A", "52", "A", 3.0, 1.0, 0.5, 1.0, 9.0, "C", False, 1),
    (5, "O5'", "", "ATP", "B", "-3", "", 4.0, 1.0, 0.5, 1.0, 9.0, "O", True, 1),
    (6, "N", "", "MET", "A", "1", "", 1.75, 2.25, -3.0, 1.0, 20.5, "N", False, 2),
]


def _pdb(atoms):
    lines, last = ["HEADER    TEST"], None
    for n, name, alt, res, chain, number, ins, x, y, z, occ, b, element, het, model in atoms:
        if model != last:
            lines += ["ENDMDL"] * (last is not None) + [f"MODEL     {model:>4}"]
            last = model
        lines.append(f"{'HETATM' if het else 'ATOM':<6}{n:>5} {' ' + name:<4}{alt:1}{res:>3} {chain}{number:>4}{ins:1}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}          {element:>2}")
    return "\n".join([*lines, "ENDMDL", "END"]) + "\n"


HEAD = """data_TEST
# a comment with loop_ and _atom_site.id
_struct.title
;A title over lines
loop_
_atom_site.id 7
;
_entry.note 'it''s "quoted" loop_'
loop_
_entity.id
_entity.details
1 'a b'
2 ;no-block
#
"""
FIELDS = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_asym_id pdbx_PDB_model_num".split()


def _values(n, name, alt, res, chain, number, ins, x, y, z, occ, b, element, het, model):
    quoted = f'"{name}"' if "'" in name else name
    return ["HETATM" if het else "ATOM", n, element, quoted, alt or ".", res, "Z", ".", ins or "?", x, y, z, occ, b, number, chain, model]


def _cif(atoms):
    table = "loop_\n" + "".join(f"_atom_site.{f}\n" for f in FIELDS) + "".join(" ".join(map(str, _values(*a))) + "\n" for a in atoms)
    return HEAD + table + "#\nloop_\n_other.id\n1\n2\n"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    at = tmp_path_factory.mktemp("structures")
    (at / "one.pdb").write_text(_pdb(ATOMS))
    (at / "one.cif").write_text(_cif(ATOMS))
    return at


def _rows(df):
    return sorted(tuple(r) for r in df.drop("file").collect())


def test_both_formats_give_equal_atoms(spark, files):
    cif, pdb = S.read_mmcif_atoms(spark, str(files / "one.cif")), S.read_pdb_models(spark, str(files / "one.pdb"))
    want = sorted((m, n, name, alt, res, chain, number + ins, x, y, z, occ, b, element, het) for n, name, alt, res, chain, number, ins, x, y, z, occ, b, element, het, m in ATOMS)
    assert _rows(cif) == want
    assert _rows(pdb) == want
    assert cif.columns == pdb.columns and dict(cif.dtypes) == dict(pdb.dtypes)


def test_models_and_alternate_locations(spark, files):
    for atoms in (S.read_mmcif_atoms(spark, str(files / "one.cif")), S.read_pdb_models(spark, str(files / "one.pdb"))):
        ids = lambda df: sorted(r.atom_id for r in df.collect())
        assert ids(S.of_model(atoms)) == [1, 2, 3, 4, 5]
        assert ids(S.of_model(atoms, 2)) == [6]
        assert ids(S.of_model(atoms, 1, "A")) == [1, 2, 4, 5]
        assert ids(S.of_model(atoms, 3)) == []


def test_without_models(spark, tmp_path):
    (tmp_path / "plain.pdb").write_text("\n".join(line for line in _pdb(ATOMS[:2]).split("\n") if not line.startswith(("MODEL", "ENDMDL"))))
    atoms = S.read_pdb_models(spark, str(tmp_path / "plain.pdb"))
    assert [(r.atom_id, r.model) for r in atoms.orderBy("atom_id").collect()] == [(1, 1), (2, 1)]
    assert _rows(atoms.drop("model")) == _rows(R.read_pdb_atoms(spark, str(tmp_path / "plain.pdb")))


def test_one_atom_as_items_and_no_atoms(spark, tmp_path):
    (tmp_path / "a.cif").write_text("data_A\n" + "".join(f"_atom_site.{f} {v}\n" for f, v in zip(FIELDS, _values(*ATOMS[0]))) + "_cell.length_a 3\n")
    (tmp_path / "b.cif").write_text("data_B\n_cell.length_a 3\n")
    (tmp_path / "c.cif").write_text("")
    rows = S.read_mmcif_atoms(spark, str(tmp_path)).select(F.regexp_extract("file", r"(\w)\.cif", 1).alias("f"), "atom_id", "x").collect()
    assert [tuple(r) for r in rows] == [("a", 1, 1.5)]


def test_more_atoms_than_a_batch(spark, tmp_path, monkeypatch):
    many = [(k + 1, *ATOMS[0][1:]) for k in range(S.BATCH + 7)]
    (tmp_path / "many.cif").write_text(_cif(many))
    row = S.read_mmcif_atoms(spark, str(tmp_path / "many.cif")).agg(F.count("*"), F.countDistinct("atom_id"), F.max("atom_id")).first()
    assert tuple(row) == (S.BATCH + 7,) * 3


def test_broken_tables_raise():
    with pytest.raises(ValueError, match="not whole"):
        list(S.atom_rows("loop_\n_atom_site.id\n_atom_site.Cartn_x\n1 2.0\n2\n"))
    with pytest.raises(ValueError, match="not closed"):
        list(S.tokens("_a.b\n;text\n"))


def test_tokens():
    assert list(S.tokens("a 'b c' \"d'e\" 'f'g' # h\n;x\ny\n; z\n'.' .")) == [("a", False), ("b c", True), ("d'e", True), ("f'g", True), ("x\ny", True), ("z", False), (".", True), (".", False)]
