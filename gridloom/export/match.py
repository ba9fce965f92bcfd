"""Which of the loaded tables fits a requested schema, and its columns put in that shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.catalog import Table
from gridloom.export.validate import Verdict, validate


def normal(name: str) -> str:
    return " ".join(name.split()).lower()


def overlaps(tables: DataFrame, wanted: list[str]) -> DataFrame:
    """``tables`` (label, columns array<string>, pos) with ``overlap``, the share of wanted columns each covers."""
    want = F.array(*[F.lit(w) for w in sorted({normal(w) for w in wanted})])
    have = F.transform("columns", lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))))
    return tables.withColumn("overlap", F.size(F.array_intersect(want, have)) / F.size(want))


def best_table(tables: list[Table], wanted: list[str], least: float = 0.6) -> Table | None:
    """The first table of the greatest overlap, if that reaches ``least``."""
    want = {normal(w) for w in wanted}
    scored = [(len(want & {normal(c) for c in t.df.columns}) / len(want), -i) for i, t in enumerate(tables)] if want else []
    score, place = max(scored, default=(0.0, 0))
    return tables[-place] if score >= least else None


def reshaped(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Exactly the wanted columns in their order; those the table lacks are empty text."""
    have = {normal(c): c for c in df.columns}
    return df.select(*[F.col(f"`{have[normal(w)]}`").alias(w) if normal(w) in have else F.lit("").alias(w) for w in wanted])


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    new = {normal(k): v for k, v in names.items()}
    return df.withColumnsRenamed({c: new[normal(c)] for c in df.columns if normal(c) in new})


def kept(df: DataFrame, wanted: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """The wanted columns, named by their old or new name; all columns if none of them is there."""
    want = {normal(w) for w in wanted} | {normal(v) for k, v in (names or {}).items() if normal(k) in {normal(w) for w in wanted}}
    found = [c for c in df.columns if normal(c) in want]
    return df.select(*[f"`{c}`" for c in found]) if found else df


def prepared(tables: list[Table], wanted: list[str] | None = None, names: dict[str, str] | None = None, reshape=None) -> tuple[list[DataFrame], Verdict | None]:
    """Tables ready to be written, and the verdict on them if a schema of four columns or more was asked for.

    Such a schema takes the table that covers it best. If that fails the checks, ``reshape(tables, wanted)``, a model
    behind a function, may try twice; what still fails is returned with its verdict. Otherwise tables that share no
    column with the request are skipped, and the rest renamed and cut to the columns kept.
    """
    wanted, names = wanted or [], names or {}
    if len(wanted) >= 4:
        out, verdict = None, Verdict(False, ["no table covers the requested columns"])
        if (direct := best_table(tables, wanted)) is not None:
            out = reshaped(direct.df, wanted)
            verdict = validate(out, wanted)
        for _ in range(2 if reshape else 0):
            if verdict.ok:
                break
            out = reshape(tables, wanted)
            verdict = validate(out, wanted)
        return ([out] if out is not None else []), verdict
    targets = {normal(n) for n in [*names, *wanted]}
    chosen = [t for t in tables if not targets or targets & {normal(c) for c in t.df.columns}]
    return [kept(renamed(t.df, names), wanted, names) if wanted else renamed(t.df, names) for t in chosen], None
