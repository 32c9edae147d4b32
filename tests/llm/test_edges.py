"""Nulls, empty and long texts, ties and repeated rows, empty tables and clashing names."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from skewprobe.llm import chat, pieces, range_coder, simhash, token_files, toxicity
from skewprobe.llm.collision_search import search
from skewprobe.llm.components import components
from skewprobe.llm.lines import dedup_lines
from skewprobe.llm.metric_join import vector_groups
from skewprobe.llm.mixing import mix
from skewprobe.llm.urls import RULES, judge_urls
from skewprobe.session import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Size string, rule string, n_lines string"
LONG = "lang word " * 30000
ROWS = [
    (1, None, None, None, None, "s", "r", "n"),
    (2, "", "x", "a", 0, "s", "r", "n"),
    (None, "one two three", "x", "a", 13, "s", "r", "n"),
    (3, "one two three", "x", "a", 13, "s", "r", "n"),
    (3, "one two three", "x", "a", 13, "s", "r", "n"),
    (4, LONG, "x", "b", len(LONG), "s", "r", "n"),
    (5, " \n\t\n ▁ é 梦 <|endoftext|>", "x", "b", 9, "s", "r", "n"),
]
BPE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_urls(spark):
    ship(spark)
    rules = spark.createDataFrame(
        [("a.com", "/x", "block"), ("a.com", "/xy", "allow"), ("com", None, "block"), (None, "/", "block"), ("b.org", "/", None)],
        RULES,
    )
    pages = spark.createDataFrame(
        [(1, "http://W.A.com/xyz?q", "h"), (2, "https://a.com/x#f", "h"), (3, None, "h"), (4, "", "h"),
         (5, "nothing", "h"), (6, "http://b.org/", "h"), (6, "http://b.org/", "h"), (7, "http://xa.net/x", "h"),
         (8, "ftp://" + "l." * 3000 + "com/" + "p/" * 3000, "h"), (None, "http://a.com", "h")],
        "page_id long, url string, Host string",
    )
    out = judge_urls(pages, rules)
    assert sorted(c.lower() for c in out.columns) == ["host", "page_id", "path", "rule", "url", "verdict"]
    got = sorted((r.page_id or 0, r.rule, r.verdict) for r in out.collect())
    assert got == [
        (0, "com", "block"), (1, "a.com/xy", "allow"), (2, "a.com/x", "block"), (3, None, "allow"),
        (4, None, "allow"), (5, None, "allow"), (6, "b.org/", "allow"), (6, "b.org/", "allow"),
        (7, None, "allow"), (8, "com", "block"),
    ]
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert judge_urls(pages, rules.limit(0)).where("rule is null").count() == 10


def test_lines(docs, empty):
    out = dedup_lines(docs, min_docs=3)
    assert sorted(out.columns) == sorted([*docs.columns, "n_dropped"])
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got[1] == ("", 1, 0) and got[2] == ("", 1, 0)
    assert got[3] == ("", 1, 1) and got[None] == ("", 1, 1)
    assert got[4] == (LONG, 1, 0) and got[5][1:] == (3, 0)
    assert dedup_lines(empty).count() == 0


def test_lines_are_kept_in_order(spark):
    rows = [(i, f"Common \nown {i}\n\n  common") for i in range(5)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5)
    assert sorted(r.text for r in out.collect()) == [f"own {i}\n" for i in range(5)]


def test_simhash(docs, empty):
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got[:4] == [(0, 3), (1, 1), (2, 1), (3, 3)] and len(got) == len(ROWS)
    kept = simhash.keep_one(docs, words=3)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert simhash.simhash_groups(empty).count() == 0 and simhash.keep_one(empty, 5).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 3, 5])
@pytest.mark.parametrize("groups", [(2,), (3,), (4,)])
def test_links_lose_nothing(spark, distance, groups, monkeypatch):
    """Dense neighbourhoods, long keys cut into tiles: the components of all pairs."""
    rng = np.random.default_rng(distance)
    centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)]
    fps = np.unique([int(c) ^ f for c in centres for f in flips])
    fps = np.array([int(f) for f in fps], np.uint64)
    monkeypatch.setattr(simhash, "TILE", 20)
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    links = simhash.links(table, distance, groups)
    roots = {r.node: r.root for r in components(links).collect()} if distance else {}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= distance
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None], len(fps)).min(1)
        if (low == label).all():
            break
        label = low
    mine = [roots.get(int(f), int(f)) for f in fps.view(np.int64)]
    pairs = {(a, b) for a, b in zip(mine, label.tolist(), strict=True)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, docs, empty):
    out = mix(docs, (5.0, 2.0, 1.0), bins=4)
    assert {"size", "source_size", "target", "copies", "taken"} <= set(out.columns) and "Size" not in out.columns
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mix(docs, (5.0, 2.0, 1.0), bins=4).collect()))
    assert mix(empty, (1.0,)).count() == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"s{i % 4}" if i % 3 else "hot") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for bins in (1, 8, 4096):
        out = mix(table, (5.0, 2.0, 1.0), bins=bins).toPandas()
        for _, part in out.groupby("source"):
            assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 40
        assert abs(out.groupby("source")["target"].first().sum() - out["size"].sum()) < 1e-6 * out["size"].sum()
    liked = mix(table, (1.0, 9.0), prefer=F.when(F.col("doc_id") % 2 == 0, 20.0).otherwise(1.0)).toPandas()
    # Within one source, which holds ids of both kinds.
    half = liked[liked["source"] == "hot"]
    assert half[half["doc_id"] % 2 == 0]["copies"].mean() > 2 * half[half["doc_id"] % 2 == 1]["copies"].mean()


@pytest.mark.parametrize("ids", [[7] * 100, [None] * 100, [7] * 60 + [None] * 40])
def test_mixing_meets_targets_with_equal_ids(spark, ids):
    """Of rows that draw the same number as many are taken as fit."""
    rows = [(i, "w " * 10, "a") for i in ids] + [(1000, "w " * 1000, "b")]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 0.375), ("b", 0.625)], "source string, weight double")
    out = mix(table, weights)
    taken = {r.source: (r.target, r.s, r.n) for r in out.groupBy("source").agg(
        F.first("target").alias("target"), F.sum("taken").alias("s"), F.count("*").alias("n")).collect()}
    assert taken["a"][0] == 750 and taken["a"][2] == 100 and abs(taken["a"][1] - 750) <= 10
    repeated = mix(table, weights)
    assert sorted(r.copies for r in repeated.collect()) == sorted(r.copies for r in out.collect())


def test_long_chats_take_linear_time(spark):
    turns = spark.range(32_000).selectExpr(
        "1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '<|') as text"
    )
    out = chat.format_chats(turns)
    back = out.select(
        F.size(chat.read_chats(F.col("formatted"))).alias("n"), F.size("loss").alias("m"),
        F.md5(chat.read_loss(F.col("formatted"), F.col("loss"))).alias("d"),
    ).first()
    import hashlib

    want = "".join(f"t{i}<|" for i in range(1, 32_000, 2))
    assert tuple(back) == (32_000, 16_000, hashlib.md5(want.encode()).hexdigest())


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        row = spark.range(1).select(
            chat.running_sums(F.expr(f"transform(slice(sequence(0, {n}), 1, {n}), x -> int(x % 7))")).alias("s")
        ).first()
        assert row.s == [sum(x % 7 for x in range(i)) for i in range(n)]


def test_chats(spark):
    turns = spark.createDataFrame(
        [(1, 2, "user", "b", 0), (1, 1, "user", "a~0<|end|>", 0), (1, 3, "assistant", None, 0), (1, 3, "assistant", "x<|next|>|>", 0),
         (1, 4, None, "", 0), (None, None, "assistant", "</s>é", 0), (2, 1, "assistant", "q" * 50000, 0), (2, 1, "assistant", "q" * 50000, 0)],
        "conv_id long, turn long, role string, text string, formatted long",
    )
    out = chat.format_chats(turns)
    assert out.columns == ["conv_id", "formatted", "loss"]
    read = out.select(
        "conv_id", "formatted", chat.read_chats(F.col("formatted")).alias("t"),
        chat.read_loss(F.col("formatted"), F.col("loss")).alias("l"),
    )
    got = {r.conv_id: r for r in read.collect()}
    assert [(t.role, t.text) for t in got[1].t] == [
        ("user", "a~0<|end|>"), ("user", "b"), ("assistant", ""), ("assistant", "x<|next|>|>"), ("", ""),
    ]
    assert got[1].l == "x<|next|>|>" and got[None].l == "</s>é" and got[2].l == "q" * 100000
    assert got[1].formatted.count("<|user|>") == 1 and got[1].formatted.count("<|next|>") == 2
    assert chat.format_chats(turns.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, n_links string"


def test_vector_groups(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 8))
    x = np.concatenate([base + 0.15 * rng.standard_normal((40, 8)) for _ in range(10)]).astype(np.float32)
    x[50:60] = x[50]
    bad = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0] * 7 + [float("inf")], [1.0] * 7 + [None]]
    rows = [(i, v.tolist(), "") for i, v in enumerate(x)] + [(1000 + i, v, "") for i, v in enumerate(bad)]
    out = vector_groups(spark.createDataFrame(rows, VECTORS), 0.9, chunk=32).toPandas().set_index("vec_id")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, True)
    label = np.arange(len(x))
    while not (low := np.where(near, label[None], len(x)).min(1)).tolist() == label.tolist():
        label = low
    for i in range(len(x)):
        assert (out.loc[i, "n_links"], out.loc[i, "component_id"]) == (near[i].sum() - 1, label[i])
        assert out.loc[i, "kept"] == (label[i] == i)
    for i in range(1000, 1006):
        assert out.loc[i].tolist() == [0, i, True]
    assert vector_groups(spark.createDataFrame([], VECTORS)).count() == 0
    twice = spark.createDataFrame([(7, [1.0, 0.0], ""), (7, [1.0, 0.0], ""), (None, [1.0, 0.0], "")], VECTORS)
    assert sorted(map(repr, vector_groups(twice).collect())) == sorted(
        ["Row(vec_id=7, n_links=2, component_id=7, kept=True)"] * 2
        + ["Row(vec_id=None, n_links=2, component_id=7, kept=False)"]
    )


@pytest.mark.parametrize(("rank", "dim"), [(8, 64), (64, 64)])
def test_recall_over_many_blocks(spark, rank, dim, monkeypatch):
    """Rows near a plane of few dimensions, and rows without structure, in some twenty blocks."""
    from skewprobe.llm import collision_search

    ship(spark)
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((5000, rank)) @ rng.standard_normal((rank, dim)) + 0.01 * rng.standard_normal((5000, dim))
    x[4000:4300] = x[17]
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = search(table, table.where("vec_id % 100 = 0"), k=10, block_rows=256).toPandas()
    hit = total = 0
    for q in range(0, 5000, 100):
        apart = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(5000), apart)) if i != q][:10]
        mine = found[found["query_id"] == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 11))
        hit += (mine["score"].to_numpy() <= apart[want[-1]] * (1 + 1e-9)).sum()
        total += 10
    assert hit / total >= 0.9
    # A bound from the first blocks leaves fewer rows to measure.
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:600])], "vec_id long, embedding array<double>")
    block = next(collision_search.build_index(rows, block_rows=600).toPandas().itertuples(index=False))
    own = collision_search.Block(block, collision_search.DIRECTIONS)
    seen = []
    monkeypatch.setattr(collision_search._State, "verify", _counted(collision_search._State.verify, seen))
    shadow = x[:1] @ collision_search.directions(dim, collision_search.DIRECTIONS, 7)
    near = np.sort(np.sqrt(((x - x[0]) ** 2).sum(1)))[10]
    for bound in (np.inf, near):
        own.nearest(np.array([0]), x[:1], shadow, 10, np.array([bound]))
        seen.append(None)
    open_, bounded = (max(n) for n in _cut(seen))
    assert bounded <= open_


def _counted(verify, seen):
    def call(state, *args):
        out = verify(state, *args)
        seen.append(int(state.seen.sum()))
        return out

    return call


def _cut(items):
    out = [[]]
    for x in items:
        if x is None:
            out.append([])
        else:
            out[-1].append(x)
    return [x for x in out if x]


def test_search_edges(spark):
    ship(spark)
    rows = [(0, [0.0, 1.0], ""), (1, [0.0, 1.0], ""), (2, [0.0, 1.0], ""), (3, [3.0, 5.0], ""), (4, None, ""), (5, [0.0, 0.0], ""), (None, [1.0, 1.0], "")]
    table = spark.createDataFrame(rows, VECTORS)
    got = [tuple(r) for r in search(table, table.where("vec_id in (0, 4)"), k=10).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 5.0)]
    assert search(table.limit(0), table, k=2).count() == 0 and search(table, table.limit(0), k=2).count() == 0


def test_pieces(docs, empty):
    encoded = pieces.encode_texts(docs.withColumn("IDS", F.lit(1)), MODEL)
    got = encoded.withColumn("back", pieces.decode_ids(F.col("ids"), MODEL)).collect()
    assert all(r.back == r.text for r in got) and len(got) == len(ROWS)
    again = pieces.encode_texts(docs.repartition(5), MODEL).collect()
    assert sorted((r.text or "", r.ids or []) for r in got) == sorted((r.text or "", r.ids or []) for r in again)
    assert pieces.encode_texts(empty, MODEL).count() == 0


def test_long_units(monkeypatch):
    """In windows as a whole: the same ids where both ways are open, and any length in bounded memory."""
    loaded = pieces.load_pieces(MODEL, 1.0)
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzé梦")
    texts = ["".join(rng.choice(letters, n)) + " and " + "".join(rng.choice(letters, n)) for n in (300, 700, 1500)]
    keys = np.array([5, 6, 7], np.uint64)
    monkeypatch.setattr(pieces, "WINDOW", 64)
    windows = pieces.sample_ids(texts, keys, loaded)
    monkeypatch.setattr(pieces, "LONG_UNIT", 1 << 20)
    whole = pieces.sample_ids(texts, keys, loaded)
    for a, b, text in zip(windows, whole, texts, strict=True):
        assert a.tolist() == b.tolist()
        assert b"".join(loaded.text[i] for i in a)[1:].decode() == text


def test_a_line_without_spaces():
    loaded = pieces.load_pieces(MODEL, 1.0)
    text = "".join(np.random.default_rng(4).choice(list("abcdefghij"), 300_000))
    (ids,) = pieces.sample_ids([text], np.array([9], np.uint64), loaded)
    assert b"".join(loaded.text[i] for i in ids)[1:].decode() == text


def test_near_keys_share_no_draws():
    positions = pieces.spots(0, 2000)
    draws = [pieces.random_unit(pieces.mixed(np.array([k], np.uint64)), positions) for k in range(200)]
    flat = np.concatenate(draws)
    assert len(np.unique(flat)) == len(flat)
    assert abs(flat.mean() - 0.5) < 0.005 and abs(np.corrcoef(draws[0][1:], draws[1][:-1])[0, 1]) < 0.1


def test_pieces_follow_the_lattice():
    """Sampled paths occur as often as the weights of all paths say."""
    model = pieces.load_pieces(MODEL, 1.0)
    weight = {}
    for _, _, _, ids, weights in model.tables.values():
        weight.update({model.text[i].decode(): (int(i), w) for i, w in zip(ids, weights, strict=True)})
    text, paths = "then.on", []

    def walk(at, ids, w):
        if at == len(text) + 1:
            paths.append((tuple(ids), w))
        for to in range(at + 1, len(text) + 2):
            if (" " + text)[at:to] in weight:
                i, x = weight[(" " + text)[at:to]]
                walk(to, [*ids, i], w * x)

    walk(0, [], 1.0)
    n, total = 40000, sum(w for _, w in paths)
    found = [tuple(x.tolist()) for x in pieces.sample_ids([text] * n, np.arange(n) * 7919, model)]
    for ids, w in paths:
        assert abs(found.count(ids) / n - w / total) < 0.012


def test_token_files(spark, docs, empty, tmp_path):
    token_files.write_token_files(docs, f"{tmp_path}/a", BPE, end=2, parts=3, file_ids=50, block_ids=16)
    read = token_files.read_token_files(spark.read.parquet(f"{tmp_path}/a")).orderBy("start").collect()
    tokenizer = token_files.load_tokenizer(BPE)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in
            ["one two three", None, "", "one two three", "one two three", LONG, ROWS[-1][1]]]
    assert [r.ids for r in read] == want and [r.doc_id for r in read] == [None, 1, 2, 3, 3, 4, 5]
    assert [r.start for r in read] == [sum(map(len, want[:i])) for i in range(len(want))]
    token_files.write_token_files(empty, f"{tmp_path}/b", BPE)
    assert token_files.read_token_files(spark.read.parquet(f"{tmp_path}/b")).count() == 0


def test_parts_of_texts_have_the_ids_of_the_whole():
    tokenizer = token_files.load_tokenizer(BPE)
    texts = ["a  b", " a", "a ", "don't  stop \n now", "x\n y\t z", "é ▁ 梦 1st (it) ...", "a b c　 d", "<|endoftext|> x <|endoftext|>"]
    for text, ids in zip(texts, token_files.tokenize(texts, tokenizer, None), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_parts_met_before_are_not_encoded_again(monkeypatch):
    tokenizer, given = token_files.load_tokenizer(BPE), []

    class Noted:
        def encode_batch_fast(self, parts, **settings):
            given.extend(parts)
            return tokenizer.encode_batch_fast(parts, **settings)

    texts = ["one two three", "two three  one", "", "one two three four"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    known = token_files.Parts()
    for text, ids in zip(texts * 2, want * 2, strict=True):
        assert token_files.tokenize([text], Noted(), None, known)[0].tolist() == ids
    assert len(given) == len(set(given)) == 6
    # Forgotten once there are many, and found anew.
    monkeypatch.setattr(token_files, "KNOWN_CHARS", 9)
    for text, ids in zip(texts, want, strict=True):
        assert token_files.tokenize([text], Noted(), None, known)[0].tolist() == ids
        assert known.chars <= 9


def test_many_parts_are_strung_together():
    tokenizer, given = token_files.load_tokenizer(BPE), []

    class Noted:
        def encode_batch_fast(self, parts, **settings):
            given.extend(parts)
            return tokenizer.encode_batch_fast(parts, **settings)

        def get_vocab(self, **settings):
            return tokenizer.get_vocab(**settings)

    rng = np.random.default_rng(5)
    ends = ["", ".", "\n", "é", "梦", "'s", "12", "<|endoftext|>", "\n\n", "\u3000"]
    words = [f"{rng.integers(10**6):x}{ends[i % len(ends)]}" for i in range(3000)]
    # Odd spaces, parts that are not plain, and first parts of texts, with and without a space.
    texts = [" ".join(words[a : a + 100]) for a in range(0, 3000, 100)]
    texts += [" " + words[0], " \u3000x", "a  b", "", "\tx y", *words[:5]]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for end, more in ((None, []), (2, [2])):
        given.clear()
        found = token_files.tokenize(texts, Noted(), end)
        assert [x.tolist() for x in found] == [ids + more for ids in want]
        assert len(given) < 100


def test_parts_are_encoded_each_where_ids_do_not_tell_their_bytes():
    tokenizer = token_files.load_tokenizer(BPE)

    class Other:
        def encode_batch_fast(self, parts, **settings):
            return tokenizer.encode_batch_fast(parts, **settings)

        def get_vocab(self, **settings):
            return {token + "#": i for token, i in tokenizer.get_vocab(**settings).items()}

    text = " ".join(f"{i * 7919:x}" for i in range(3000))
    assert token_files.tokenize([text], Other(), None)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_coded_words_stay_as_they_are():
    """Files written before are read by the same model; blocks of unequal length, counted and new ids, all orders."""
    at = np.arange(6 * 500, dtype=np.int64).reshape(6, 500)
    ranks = ((at * at % 97) * (at % 7 < 4) + at * 31 % 40 * (at % 7 >= 4)).astype(np.int32)
    ranks[5, 300:] = 0
    sizes = np.array([500] * 5 + [300])
    words = range_coder.encode_blocks(ranks, sizes, np.append(np.arange(97) * 600, 1 << 16), 16)
    coded = [368144736, 2073979371, 2567006767, 486060483, 3581156308, 2224111398]
    assert [zlib.crc32(w.astype("<u4").tobytes()) for w in words] == coded


def test_margins_hold_kernel_values_of_few_units():
    import tracemalloc

    units = [f"{i:05d}word" for i in range(1 << 14)]
    kernel = toxicity.Kernel(units[:192])
    model = toxicity.Model(kernel, np.ones(192), 0.0, np.array([1.0, 0.5, 0.0]), 0.1)
    tracemalloc.start()
    margins = model.margins(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    assert np.allclose(margins[-9:], model.margins(units[-9:]), rtol=1e-12)


@pytest.mark.parametrize("block", [1, 7, 64, 2048])
def test_packing(block):
    rng = np.random.default_rng(block)
    ids = [rng.integers(0, 9, 300), np.zeros(0, int), rng.integers(0, 2**32, 200), np.full(5000, 4)]
    payload = token_files.pack([1, None, 3, 4], ids, block)
    docs, stream = token_files.unpack(payload)
    assert stream.tolist() == np.concatenate(ids).tolist() and docs["n"].tolist() == [300, 0, 200, 5000]
    damaged = bytearray(payload)
    damaged[-9] ^= 64
    with pytest.raises(ValueError):
        token_files.unpack(bytes(damaged))


def test_coder_carries():
    """Ranks of a few almost certain values push the low end over its limit."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        ranks = (rng.random((3, 400)) < 0.02).astype(np.int32) * 2 + 0
        start = np.array([0, 1, 2, 1 << 16])
        words = range_coder.encode_blocks(ranks, np.full(3, 400), start, 16)
        table = np.zeros((3, max(map(len, words)) + 2), np.uint32)
        for k, w in enumerate(words):
            table[k, : len(w)] = w
        assert (range_coder.decode_blocks(table, np.full(3, 400), start, 16) == ranks).all()


def words_of(ranks, start, bits):
    words = range_coder.encode_blocks(ranks, np.full(len(ranks), ranks.shape[1]), start, bits)
    table = np.zeros((len(ranks), max(map(len, words)) + 2), np.uint32)
    for k, w in enumerate(words):
        table[k, : len(w)] = w
    assert (range_coder.decode_blocks(table, np.full(len(ranks), ranks.shape[1]), start, bits) == ranks).all()
    return [len(w) for w in words]


def test_order_0_adapts_in_each_block():
    """Blocks in random order over 16 of 4,096 equally frequent ids: 4 bits an id, not 12, once the ids are known."""
    rng = np.random.default_rng(3)
    ranks = np.stack([rng.choice(4096, 16, replace=False)[rng.integers(0, 16, 2000)] for _ in range(6)]).astype(np.int32)
    start = np.arange(4097) << 4
    for n in words_of(ranks, start, 16):
        assert 4.0 < n * 32 / 2000 < 5.2
    # Unequal counts in a block: towards their entropy, whatever the file's frequencies. What is above it
    # is spent on orders 1 and 2, which guess in vain here, and whose guesses order 0 does not leave out.
    odds = 0.5 ** np.arange(1, 9)
    ranks = rng.choice(8, (4, 2000), p=odds / odds.sum()).astype(np.int32) * 500
    entropy = -(odds / odds.sum() * np.log2(odds / odds.sum())).sum()
    for n in words_of(ranks, start, 16):
        assert n * 32 / 2000 < 1.4 * entropy


@pytest.mark.parametrize("length", [1, 2, 3, 33, 1000])
def test_counts_of_growing_ids(length):
    rng = np.random.default_rng(length)
    ranks = np.minimum(rng.geometric(0.2, (5, length)) - 1, 15).astype(np.int32)
    ranks[1], ranks[2] = 0, np.arange(length) % 16
    words_of(ranks, np.arange(17) << 12, 16)


def test_damage_is_always_seen():
    rng = np.random.default_rng(9)
    payload = token_files.pack([1], [rng.integers(0, 50, 3000)], 256)
    body = len(payload) - 1200
    for at in rng.integers(body, len(payload), 60):
        damaged = bytearray(payload)
        damaged[at] ^= 1 << int(rng.integers(0, 8))
        with pytest.raises(ValueError):
            token_files.unpack(bytes(damaged))


def test_toxicity(spark, docs, empty):
    words = "alder birch cedar maple poplar rowan willow yew laurel hazel".split()
    rng = np.random.default_rng(1)
    rows, marks = [(900, "."), (901, None)], [(900, 1), (901, 0)]
    for i in range(120):
        text = [words[k] + words[j] for k, j in rng.integers(0, 10, (30, 2))]
        if i % 3 == 0:
            text[int(rng.integers(30))] = f"grumbler{i % 5}"
            text[int(rng.integers(30))] = "nitwit"
        rows.append((i, " ".join(text)))
        marks.append((i, int(i % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None), (7, 9)], "doc_id long, toxic int")
    model = toxicity.train(table, labels, landmarks=40)
    score = model.scores(["alderbirch nitwit cedar grumbler", "alder n i t w i t n.i.t.w.i.t", "nit*wit nitxwit", "alder cedar", ""])
    assert (score[:3] > 0.5).all() and (score[3:] < 0.5).all()
    out = toxicity.score_docs(docs.withColumn("TOXICITY", F.lit("a")), model)
    assert out.where("toxicity between 0 and 1").count() == len(ROWS)
    assert toxicity.score_docs(empty, model).count() == 0
    # Mostly toxic labels must not hide what is telling.
    more = labels.where("toxic = 1 or doc_id in (1, 2, 4, 7, 8, 10, 11, 13, 14, 16, 17, 19, 20, 22, 23)")
    score = toxicity.train(table, more, landmarks=40).scores(["alderbirch nitwit cedar grumbler"])
    assert score[0] > 0.5
    prior = toxicity.train(table, labels.where("toxic = 0"))
    assert prior.scores(["x"]).tolist() == [0.0]


def brute_kernel(a, b):
    """Shared triples in order, gaps allowed, by all choices of three places."""
    from itertools import combinations

    def weights(s):
        found = {}
        for places in combinations(range(len(s)), 3):
            span = places[-1] - places[0] + 1
            if span <= toxicity.SPAN:
                key = "".join(s[i] for i in places)
                found[key] = found.get(key, 0.0) + toxicity.DECAY**span
        return found

    def scale(s):
        every = [places for places in combinations(range(len(s)), 3) if places[-1] - places[0] < toxicity.SPAN]
        return sum(toxicity.DECAY ** (2 * (p[-1] - p[0] + 1)) for p in every) ** 0.5

    x, y = weights(a), weights(b)
    return (sum(w * y.get(k, 0.0) for k, w in x.items()) / (scale(a) * scale(b))) ** toxicity.POWER


def test_kernel_and_margins_against_brute_force():
    marks = ["idiot", "abcabc", "moron", "xyz"]
    units = ["idiot", "idxiot", "i9diot", "aabbcc", "zzz", "moronmoron", "xyz"]
    kernel = toxicity.Kernel(marks)
    want = np.array([[brute_kernel(u, m) for m in marks] for u in units])
    assert np.allclose(kernel.values(units), want, rtol=1e-4, atol=1e-6)
    weight = np.array([0.5, -1.0, 2.0, 0.25])
    model = toxicity.Model(kernel, weight, -0.1, np.array([1.0, 0.5, 0.0]), 0.5)
    assert np.allclose(model.margins(units), want @ weight - 0.1, rtol=1e-4, atol=1e-5)
    # The two worst units of a text, each occurrence counted.
    best = np.sort(want[[0, 4, 0]] @ weight - 0.1)[::-1]
    assert np.allclose(model.worst(["idiot zzz idiot"])[0], best[:2], atol=1e-5)


@pytest.mark.parametrize("text", ["name: " + "_" * 10_000 + end for end in (".", "a", "\n", " x")] + ["a " * 50_000 + "!x", "a" + "." * 100_000])
def test_marks_in_a_row_take_linear_time(text):
    import time

    start = time.perf_counter()
    toxicity.units_of(text)
    assert time.perf_counter() - start < 1


def test_letters_apart():
    assert "idiot" in toxicity.units_of("you i.d_i o-t !") and "idiot" in toxicity.units_of("I D I O T")


@pytest.mark.parametrize("share", [0.5, 0.1])
def test_insults_after_few_words(spark, share):
    """Toxic texts that all carry the insult in one phrase, which clean ones use as well."""
    ship(spark)
    rng = np.random.default_rng(5)
    fill = [f"word{i}" for i in range(400)]
    bad, good = ["moronix", "scumbagg", "loserly"], ["teacher", "neighbour", "student"]
    rows = []
    for i in range(600):
        toxic = int(i < 600 * share)
        end = rng.choice(bad if toxic else good)
        tail = f"you are an {end}" if toxic or i % 2 else "it rains"
        rows.append((i, " ".join(rng.choice(fill, 29)) + " " + tail, toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert model.kernel is not None
    found = toxicity.score_docs(table, model).collect()
    said = [(r.toxic, r.toxicity >= 0.5) for r in found]
    assert np.mean([b for t, b in said if t]) > 0.95 and np.mean([b for t, b in said if not t]) < 0.05


def test_an_unfitted_model_drops_nothing(spark):
    ship(spark)
    rows = [(i, "the same words", 1) for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    with pytest.warns(UserWarning, match="no toxicity model"):
        model = toxicity.train(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    assert max(r.toxicity for r in toxicity.score_docs(table, model).collect()) < 0.5
