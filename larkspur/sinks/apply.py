"""Applies a finished plan to a file system that all executors share: each partition of the plan moves its own files."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur import console
from larkspur.operators.lineage import cut

MOVES = ["move", "MERGE", "RENAME"]


def one(src: str, dest: str, action: str, dry_run: bool) -> str:
    """What became of a row of the plan. A move that a lost executor had made already counts as made."""
    try:
        if action in MOVES:
            if not dry_run:
                if os.path.lexists(dest):
                    return "skipped" if os.path.lexists(src) else "renamed" if action == "RENAME" else "moved"
                os.makedirs(os.path.dirname(dest) or ".", mode=0o755, exist_ok=True)
                shutil.move(src, dest)
            return "renamed" if action == "RENAME" else "moved"
        if action == "DROP":
            if not dry_run and os.path.lexists(src):
                os.remove(src)
            return "dropped"
        return "skipped"
    except OSError:
        return "errors"


def apply_plan(plan: DataFrame, root: str = "", dry_run: bool = False, verbose: bool = False) -> dict[str, int]:
    """Moves (move, MERGE, RENAME) and deletes (DROP) by src and dest; counts by outcome.

    Moves to places that no other row leaves run first, then those to places that are left, then drops;
    the rows of a step are spread over the cluster, as no two of them have one place. A move never
    overwrites: a place taken meanwhile counts as skipped. A dry run changes nothing. ``verbose`` prints
    each row's outcome, a partition at a time.
    """
    done = {"moved": 0, "renamed": 0, "dropped": 0, "skipped": 0, "errors": 0}
    moves = F.col("action").isin(MOVES)
    leaves = plan.where(moves | (F.col("action") == "DROP")).select(F.col("src").alias("dest"), F.lit(True).alias("_left"))
    rows = cut(plan.select("src", "dest", "action").join(leaves, "dest", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = lambda p: os.path.join(root, p) if root else p
        for b in batches:
            columns = [b.column(c).to_pylist() for c in range(3)]
            outcome = [one(at(s), at(d), a, dry_run) for s, d, a in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(outcome, pa.string())], ["src", "dest", "action", "outcome"])

    for some in (moves & F.col("_left").isNull(), moves & F.col("_left").isNotNull(), ~moves):
        # Written, so that no row is applied twice.
        log = cut(rows.where(some).select("src", "dest", "action").mapInArrow(run, "src string, dest string, action string, outcome string"))
        for r in log.groupBy("outcome").count().collect():
            done[r["outcome"]] += r["count"]
        if verbose:
            for r in log.orderBy("src").toLocalIterator():
                color = {"errors": "red", "skipped": "yellow", "dropped": "yellow"}.get(r["outcome"], "green")
                console.line(("DRY-RUN " if dry_run else "") + r["action"].upper(), f"{r['src']} -> {r['dest']}: {r['outcome']}", color)
    return done


def remove_empty_dirs(root: str, dry_run: bool = False) -> list[str]:
    """Removes the empty folders below ``root``, deepest first; the root stays, errors are passed over."""
    gone: list[str] = []
    for at, _, _ in sorted(os.walk(root), key=lambda x: len(x[0]), reverse=True):
        if at == root:
            continue
        try:
            inside = [os.path.join(at, x) for x in os.listdir(at)]
            if all(x in gone for x in inside) if dry_run else not inside:
                if not dry_run:
                    os.rmdir(at)
                gone.append(at)
        except OSError:
            continue
    return gone
