"""Limits of work and memory as columns: what was asked, what is allowed, and the first limit that is broken."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

#: Budgets of one container's parsing.
PARSE_LIMITS = {"depth": 32, "elements": 100_000, "tracks": 256, "samples": 2_000_000}


@dataclass(frozen=True)
class Policy:
    """Ceilings in bytes, and counts; the parts of a session fit the session, and sessions fit the whole."""

    session: int
    aggregate: int
    metadata: int
    index: int
    window: int
    batch: int
    output: int
    sessions: int = 1
    threads: int = 1
    pixels: int = 1

    def problem(self) -> str | None:
        """Why the policy contradicts itself, or None."""
        parts = (self.metadata, self.index, self.window, self.batch, self.output)
        if min(self.sessions, self.threads, self.pixels) <= 0 or self.threads > 64:
            return "capacity"
        if min(parts) <= 0:
            return "ceiling"
        return "sum" if sum(parts) > self.session or self.session > self.aggregate else None


def policy_problem(row: Column) -> Column:
    """The same for a struct column with the fields of Policy."""
    v = {f.name: row[f.name] for f in fields(Policy)}
    parts = [v[k] for k in ("metadata", "index", "window", "batch", "output")]
    total = sum((p.cast("decimal(38,0)") for p in parts[1:]), parts[0].cast("decimal(38,0)"))
    capacity = (F.least(v["sessions"], v["threads"], v["pixels"]) <= 0) | (v["threads"] > 64)
    return F.when(capacity, "capacity").when(F.least(*parts) <= 0, "ceiling").when((total > v["session"]) | (v["session"] > v["aggregate"]), "sum")


def checked(df: DataFrame, operation: str, limits: list[tuple[str, Column, int]], retry: str = "never") -> DataFrame:
    """Adds `error`: null, or (code, operation, resource, requested, allowed, retry) of the first limit that is exceeded, in order."""
    error = None
    for resource, requested, allowed in limits:
        made = F.struct(F.lit("resource_exceeded").alias("code"), F.lit(operation).alias("operation"), F.lit(resource).alias("resource"), requested.cast("bigint").alias("requested"), F.lit(allowed).cast("bigint").alias("allowed"), F.lit(retry).alias("retry"))
        error = F.when(requested > allowed, made) if error is None else error.when(requested > allowed, made)
    return df.withColumn("error", error)


def container_budgets(elements: DataFrame) -> DataFrame:
    """(path, elements, depth, error) of walked boxes or elements, rows (path, place-in-tree as text)."""
    depth = F.size(F.split("node", "/")) - 1
    g = elements.groupBy("path").agg(F.count("*").alias("elements"), F.max(depth).alias("depth"))
    return checked(g, "parse", [("depth", F.col("depth"), PARSE_LIMITS["depth"]), ("elements", F.col("elements"), PARSE_LIMITS["elements"])])
