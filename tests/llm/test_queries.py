"""The registered corpus queries: against their SQL, or against brute force, on the smallest tables."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from skewprobe.llm import registry

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    table = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(repr, table.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, duck, name):
    found = registry.queries()[name](spark, SF).toPandas()
    assert rows(found) == rows(duck.sql(registry.oracle_sql()[name]).df())


def test_token_files(spark, duck):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").df()
    at, want = 0, []
    for i, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = registry.op2_token_files(spark, SF).toPandas()
    assert sorted(map(tuple, found.itertuples(index=False))) == want


def brute_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=3):
    names = sorted(prints)
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for k, a in enumerate(names):
        for b in names[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in names}


def test_simhash(spark, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents").df()
    prints = {i: brute_fingerprint(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    roots = brute_components(prints)
    found = registry.op4_simhash(spark, SF).toPandas()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in found.itertuples()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def test_search_recall(spark, duck):
    table = duck.sql("SELECT vec_id, embedding FROM embeddings").df()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found = registry.op10_collision_search(spark, SF).toPandas()
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        apart = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, apart)) if ids[i] != q][:10]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        score = dict(zip(ids, apart, strict=True))
        assert np.allclose(mine["score"], [score[v] for v in mine["vec_id"]], rtol=1e-12)
        hit += len(set(ids[order]) & set(mine["vec_id"]))
        total += 10
    assert hit / total >= 0.9


def test_pieces_are_lossless(spark):
    found = registry.op9_sampled_pieces(spark, SF).toPandas()
    assert len(found) == 200 and found["lossless"].all()


def test_toxicity_held_out(spark, duck):
    """Scores are within bounds, and nearly all held-out labels are met.

    On the middle tables: the small ones have about ten held-out toxic documents.
    """
    sf = "/root/testdata/sf0.1"
    found = registry.op3_toxicity(spark, sf).toPandas()
    assert found["score"].between(0, 1).all()
    want = [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]
    assert found["held_out"].tolist() == want
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()
    labels = duck.sql(f"SELECT * FROM '{sf}/labels.parquet'").df()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    bad, said = both["toxic"] == 1, both["predicted"] == 1
    print("held out", len(both), "recall", (bad & said).sum() / bad.sum(), "precision", (bad & said).sum() / said.sum())
    # Measured: 0.91 and 0.79; some labels of these tables have no insult in the text.
    assert (bad & said).sum() / bad.sum() > 0.85 and (bad & said).sum() / said.sum() > 0.7


def test_pipeline(spark, duck):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, function in p.STAGES:
        out = function(spark, docs, SF)
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        before, docs = docs, registry.stage(out, f"test-{name}")
        seen[name] = (before.toPandas(), docs.toPandas())
    # Line dedup by brute force; equal texts count once.
    old, new = (t.set_index("doc_id")["text"] for t in seen["line_dedup"])
    holders = defaultdict(set)
    for text in old:
        for line in text.split("\n"):
            holders[line.encode().strip(b" \t\n\x0b\x0c\r").lower()].add(text)
    for i, text in old.items():
        keep = [
            x for x in text.split("\n")
            if not (k := x.encode().strip(b" \t\n\x0b\x0c\r").lower()) or len(holders[k]) < 10
        ]
        assert new[i] == "\n".join(keep)
    # Near-duplicates by brute force: one document of each component.
    old, new = seen["near_dedup"]
    prints = {r.doc_id: brute_fingerprint(r.text) for r in old.itertuples()}
    assert sorted(new["doc_id"]) == sorted(set(brute_components(prints).values()))
    # The mix repeats a document at most three times and drops no source.
    old, new = seen["mixing"]
    assert new.groupby("doc_id").size().max() <= 3
    assert set(new["source"]) == set(old["source"])
    # Pieces stand for the text.
    old, new = seen["segmentation"]
    assert len(new) == len(old) and sorted(new["text"]) == sorted(old["text"])
