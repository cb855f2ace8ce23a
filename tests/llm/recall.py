"""Held against all pairs: python tests/llm/recall.py [folder]. Takes some minutes and GB at sf0.1.

Prints how many links of 0.8 or more there are between different texts, by exact weights of all
shingles, and how many of them op6_minhash has in one class.
"""

from __future__ import annotations

import math
import os
import sys
from collections import Counter, defaultdict
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = str(ROOT)


def links(texts, least=0.8):
    words = {i: (t or "").split() for i, t in texts}
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for i, w in words.items()}
    df = Counter(x for s in sets.values() for x in s)
    n = len(sets)
    weight = {x: math.log1p(n / c) / math.log1p(n) for x, c in df.items()}
    total = {i: sum(k * weight[x] for x, k in s.items()) for i, s in sets.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            if df[x] > 1:
                holders[x].append(i)
    for i, s in sets.items():
        common: dict[int, float] = defaultdict(float)
        for x, k in s.items():
            for j in holders.get(x, ()):
                if j > i:
                    common[j] += min(k, sets[j][x]) * weight[x]
        for j, both in common.items():
            if both / (total[i] + total[j] - both) >= least:
                yield i, j, words[i] != words[j]


def main(folder: str) -> None:
    from pyspark.sql import SparkSession

    from tidewire.llm.queries import QUERIES

    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    of = {r["doc_id"]: r["class_id"] for r in QUERIES["op6_minhash"](spark, folder).collect()}
    found = [(of[i] == of[j], different) for i, j, different in links(texts)]
    print(f"{len(found)} links, {sum(d for _, d in found)} of them between different texts; within classes: {sum(f for f, _ in found)} and {sum(f for f, d in found if d)}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
