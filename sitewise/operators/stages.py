"""Stages put together from operators: alignment under a target, mean-field couplings, mutation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import alignment as A
from . import couplings as C
from . import meanfield as M
from . import mutation as U
from . import scoring as S
from .stored import stored


def cut_sequence(sequence: str, region: tuple[int, int] | None = None, first_index: int = 1) -> tuple[int, str]:
    """First index and letters of a region, both ends included; an error if it lies outside."""
    if region is None:
        return first_index, sequence
    start, end = region
    last = first_index + len(sequence) - 1
    if not first_index <= start <= end <= last:
        raise ValueError(f"region {start}-{end} is not inside {first_index}-{last}")
    return start, sequence[start - first_index : end - first_index + 1]


def target_columns(sequences: DataFrame, target: str, gaps: str = "-.") -> tuple[str, list[int]]:
    """Id of the one sequence whose id begins with ``target``, and its columns, from 1, that are no gaps."""
    found = sequences.where(F.col("id").startswith(target)).orderBy("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} sequences begin with {target!r}" if len(found) != 2 else f"several sequences begin with {target!r}")
    return found[0].id, [k for k, c in enumerate(found[0].seq, 1) if c not in gaps]


def under_target(sequences: DataFrame, target: str) -> DataFrame:
    """An alignment (``id, seq``) cut to the columns of a target, which is row 0: ``is_target`` marks it."""
    name, columns = target_columns(sequences, target)
    seq = F.array_join(F.array(*(F.substring("seq", k, 1) for k in columns)), "")
    return sequences.select("id", seq.alias("seq"), (F.col("id") == name).alias("is_target"))


def focused(rows: DataFrame, target: int, alphabet: str, n_symbols: int, sequence_coverage: float | int | None, column_coverage: float | int | None, theta: float | None, first_index: int = 1, gap: int = 0) -> dict:
    """The alignment stage from symbol rows (``seq_idx, residues``) and the target's ``seq_idx``.

    ``rows``: covered sequences, ``is_target`` marking the target; ``identities``, ``frequencies``, ``coverage``; ``low``:
    columns, from 1, with too many gaps; ``sequences``: letters, lower-case there; ``weights``: sequences like each one
    over the other columns; ``positions``: numbers of those.
    """
    kept = rows if sequence_coverage is None else A.covered_rows(rows, sequence_coverage, gap)
    reference = rows.where(F.col("seq_idx") == target).first()
    if reference is None:
        raise ValueError("the target isn't in the alignment")
    kept = kept.withColumn("is_target", F.col("seq_idx") == target)
    length = len(reference.residues)
    low: list[int] = []
    if column_coverage is not None:
        least = column_coverage / 100 if isinstance(column_coverage, int) else column_coverage
        low = sorted(r.pos for r in A.column_coverage(kept, gap).where(1 - F.col("coverage") > 1 - least).select("pos").collect())  # columns, not sequences
    high = [p for p in range(1, length + 1) if p not in set(low)]
    sites = A.site_frequencies(kept, n_symbols)
    out = {"rows": kept, "low": low, "positions": [p + first_index - 1 for p in high], "identities": A.identities_to(kept, reference.residues), "frequencies": sites}
    out["coverage"] = A.describe_coverage(kept, [least] if column_coverage is not None else [0.5], first_index, gap)
    out["sequences"] = A.lowercase_columns(A.read_out(kept, alphabet), low)
    if theta is not None:
        out["weights"] = A.sequence_weights(A.select(kept, high), theta).select("seq_idx", "n_similar", "weight")
    return out


def meanfield_ecs(rows: DataFrame, length: int, n_symbols: int, pseudo: float = 0.5) -> DataFrame:
    """The mean-field stage from (weighted) symbol rows to pairs ``i, j, mi_raw, mi_apc, di, cn``."""
    rows = stored(rows)  # weights compare all sequences
    sites, pairs = A.site_frequencies(rows, n_symbols), A.pair_frequencies(rows)
    regular_sites, regular_pairs = stored(M.regularized_sites(sites, n_symbols, pseudo)), stored(M.regularized_pairs(pairs, length, n_symbols, pseudo))
    model = stored(M.couplings(regular_pairs, regular_sites, length, n_symbols))
    table = S.ec_table(model, regular_pairs, regular_sites)
    return table.join(M.direct_information(model, regular_sites, n_symbols), ["i", "j"]).select("i", "j", "mi_raw", "mi_apc", "di", "cn")


def mutation_matrix(target: DataFrame, fields: DataFrame, couplings: DataFrame, sites: DataFrame, n_symbols: int, name: str = "prediction_epistatic") -> DataFrame:
    """All single substitutions ``i, wt, subs`` with the substitution's frequency, the column's conservation and the predicted effect."""
    effects = U.single_mutants(target, fields, couplings, n_symbols).withColumnRenamed("effect", name)
    frequency = sites.select(F.col("pos").alias("i"), F.col("sym").alias("subs"), "frequency")
    conserved = A.conservation(sites, n_symbols).select(F.col("pos").alias("i"), F.col("conservation").alias("column_conservation"))
    return effects.join(frequency, ["i", "subs"]).join(conserved, "i")


def mutation_predictions(mutants: DataFrame, target: DataFrame, fields: DataFrame, couplings: DataFrame, independent: DataFrame) -> DataFrame:
    """``mutant`` with its effect under the pair model and under a model of sites alone."""
    none = couplings.limit(0)
    full = U.mutant_effects(mutants, target, fields, couplings).withColumnRenamed("effect", "prediction_epistatic")
    alone = U.mutant_effects(mutants, target, independent, none).withColumnRenamed("effect", "prediction_independent")
    return full.join(alone, "mutant")


def rescored(ecs: DataFrame, how: str, score: str, n_sites: int, ties: tuple = ("i", "j"), **logistic) -> tuple[DataFrame, DataFrame]:
    """Pairs rescored by ``logistic`` regression or a mixture model of that name, and how many of the first are expected to be true."""
    rows = S.logistic_rescored(ecs, score=score, **logistic) if how == "logistic" else S.with_mixture_probability(ecs, how, score)
    return rows, C.expected_true(rows, n_sites, "score" if how == "logistic" else score, ties=ties)
