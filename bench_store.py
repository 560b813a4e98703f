"""Times of single operations on a store, in milliseconds: what ``bench.py`` adds to its line."""

from __future__ import annotations

import json
import os
import random
import shutil
import statistics
import sys
import tempfile
import time

from rootline.session import create_session
from rootline.sources.store import LineageStore


def _timed(times: int, work) -> float:
    took = []
    for i in range(times):
        began = time.perf_counter()
        work(i)
        took.append(time.perf_counter() - began)
    return round(1000 * statistics.median(took), 3)


def measure(spark, nodes: int = 250) -> dict[str, float]:
    """Medians over a store of small nodes in chains of ten, and one file of 4 MB."""
    folder, out = tempfile.mkdtemp(prefix="store-"), {}
    try:
        with LineageStore(folder + "/s", spark) as store:
            made: list[str] = []

            def create(i: int) -> None:
                with store.create_node("train" if i % 10 else "ingest", made[-1] if i % 10 else None) as n:
                    for k in range(4):
                        n.add_meta(f"k{k}", i)
                made.append(n.node_id)

            out["create_node"] = _timed(nodes, create)
            data = random.Random(1).randbytes(4_000_000)
            last: list[str] = []

            def write(i: int) -> None:
                with store.create_node("ingest") as n:
                    (n / "f.bin").write_bytes(data[i:] + data[:i] if i else data)
                last.append(n.node_id)

            out["write_4mb_cold"] = _timed(1, write)

            def read(_: int) -> None:
                store.close()
                store.artifact_path(last[0], "f.bin").read_bytes()

            out["read_4mb_cold"] = _timed(5, read)
            out["get"] = _timed(50, lambda i: store.get(made[i % len(made)]))
            out["children"] = _timed(50, lambda i: store.children(made[i % len(made)]))
            out["lineage_10"] = _timed(20, lambda i: store.lineage(made[9]))
            store.find(step_type="train")
            out["find_all"] = _timed(5, lambda _: store.find())
            out["find_meta"] = _timed(5, lambda i: store.find(k0=i))
            out["find_predicate"] = _timed(3, lambda i: store.find(k1=lambda v: v is not None and v > 100))
            out["prune_dry_run"] = _timed(3, lambda i: store.prune(made[5]))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    return out


if __name__ == "__main__":
    print(json.dumps(measure(create_session("store", f"local[{os.environ.get('BENCH_CPUS', '8')}]"), int(sys.argv[1]) if len(sys.argv) > 1 else 250)))
