"""The pipeline's stages against brute force on the smallest table."""

import itertools
import re

import corpus_pipeline
from wardlake.llm import quality


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns
        before, docs = docs.collect(), now
        kept = {r["doc_id"]: r for r in after[name]}
        if name == "quality_rules":
            good = {r["doc_id"] for r in quality.apply_policy(quality.ledger(spark.read.parquet(f"{data}/documents.parquet"))).where("kept").collect()}
            assert set(kept) == good
        elif name == "near_duplicates":
            sets = {r["doc_id"]: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for r in before for w in [[x.lower() for x in words(r["text"])]]}
            comp = {i: i for i in sets}
            for a, b in itertools.combinations(sorted(sets), 2):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * len(sets[a] | sets[b]) and comp[a] != comp[b]:
                    lo, hi = sorted((comp[a], comp[b]))
                    comp = {i: lo if c == hi else c for i, c in comp.items()}
            assert set(kept) == set(comp.values())
        elif name == "repeated_passages":
            seen = {}
            for r in before:
                w = words(r["text"])
                for j in range(len(w) - 34):
                    seen.setdefault(tuple(w[j : j + 35]), []).append((r["doc_id"], j))
            gone = {r["doc_id"]: set() for r in before}
            for places in seen.values():
                if len(places) > 1:
                    for i, j in places:
                        gone[i].update(range(j, j + 35))
            for r in before:
                i = r["doc_id"]
                assert kept[i]["text"] == (" ".join(w for j, w in enumerate(words(r["text"])) if j not in gone[i]) if gone[i] else r["text"])
        elif name == "secret_scan":
            assert len(kept) == len(before)
            assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"]) for r in after[name])
            assert sum(r["text"] == kept[r["doc_id"]]["text"] for r in before) > 0.8 * len(before)
        else:
            tokens = {}
            for p in after[name]:
                tokens[p["doc_id"]] = tokens.get(p["doc_id"], 0) + p["length"]
                assert p["ids_crc32"] < 2**32
            assert set(tokens) == {r["doc_id"] for r in before}
    assert sorted(map(str, corpus_pipeline.run(spark, data).collect())) == sorted(map(str, after["packing"]))
