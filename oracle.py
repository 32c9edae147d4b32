"""SQL for the value check: every registered query again, over the same tables.

Written independently of the Spark plans: all pairs are formed and ranked by
windows, which only a small table allows.
"""

from __future__ import annotations

import re

# Settings shared with the registered queries.
DIM, BLOCKS, K, NPROBE = 64, 4, 10, 2
GROUPS = 5
SAMPLE_ROWS, SAMPLE_PER_PART, WARM_QUERIES = 100, 20, 32
HOT_LABELS = ("0", "1", "2", "3", "4")
HOT_EVENTS = ("error",)
HOT_FLAGS = ("R",)
FLAGS = ("A", "N", "R")

WIDTH = DIM // BLOCKS


def _split(name: str, source: str, ident: str) -> list[tuple[str, str]]:
    """CTEs that rank ``source`` (ident, label) per label and give each label its quota."""
    return [
        (f"{name}_counts", f"SELECT label, count(*) AS n FROM {source} GROUP BY label"),
        (
            f"{name}_shares",
            f"""SELECT label, n * wanted // total AS whole, n * wanted % total AS rest, wanted
            FROM {name}_counts, (SELECT sum(n)::BIGINT AS total,
              ceil(0.1::DOUBLE * sum(n)::DOUBLE)::BIGINT AS wanted FROM {name}_counts)""",
        ),
        (
            f"{name}_quota",
            f"""SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
              <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_shares""",
        ),
        (
            f"{name}_ranked",
            f"""SELECT s.*, q.quota, row_number() OVER (PARTITION BY s.label
              ORDER BY md5('42:' || s.{ident}), s.{ident}) AS rn
            FROM {source} s JOIN {name}_quota q USING (label)""",
        ),
    ]


def _block(v: str, b: int) -> str:
    return f"{v}[{b * WIDTH + 1}:{(b + 1) * WIDTH}]"


def _tail(v: str, b: int) -> str:
    return f"[abs(x) for x in {v}[{b * WIDTH + 1}:{DIM}]]"


_BLOCK_COLUMNS = ", ".join(
    f"list_inner_product({_block('bv', b)}, {_block('qv', b)}) AS s{b}, "
    f"list_inner_product({_tail('bv', b)}, {_tail('qv', b)}) AS u{b}"
    for b in range(BLOCKS)
)


def _partial(b: int) -> str:
    """Score over the first ``b`` blocks."""
    return "round(" + (" + ".join(f"s{i}" for i in range(b)) or "0.0") + ", 9)"


def _optimistic(b: int) -> str:
    return "round(" + " + ".join([*(f"s{i}" for i in range(b)), f"u{b}"]) + ", 9)"


def _kth(source: str, score: str, keys: str, strict: bool = False) -> str:
    """k-th largest score per key, or the least of fewer, or nothing when strict."""
    having = f"HAVING count(*) >= {K}" if strict else ""
    return f"""SELECT {keys}, min(sc) AS t FROM (SELECT {keys}, {score} AS sc, row_number() OVER
      (PARTITION BY {keys} ORDER BY {score} DESC, vec_id) AS rk FROM {source})
      WHERE rk <= {K} GROUP BY {keys} {having}"""


def _top(source: str, keys: str, score: str = "score", cols: str = "") -> str:
    return f"""SELECT * FROM (SELECT q_id, vec_id, {cols} {score} AS score, row_number() OVER
      (PARTITION BY {keys} ORDER BY {score} DESC, vec_id)::INTEGER AS rk FROM {source})
      WHERE rk <= {K}"""


def _search_ctes(workload: str) -> list[tuple[str, str]]:
    hot = " OR ".join(f"contains(lower(label), '{p.lower()}')" for p in HOT_LABELS)
    ctes = [
        (
            "emb",
            "SELECT vec_id, embedding::DOUBLE[] AS v, label::VARCHAR AS label FROM embeddings",
        ),
        *_split("emb", "emb", "vec_id"),
        ("base", "SELECT vec_id, v, label FROM emb_ranked WHERE rn > quota"),
        ("held", f"SELECT vec_id AS q_id, v, label, {hot} AS hot FROM emb_ranked WHERE rn <= quota"),
        (
            "sizes",
            """SELECT count(*) FILTER (hot) AS n_hot, count(*) FILTER (NOT hot) AS n_cold,
              count(*) // 2 AS total FROM held""",
        ),
        (
            "skew",
            """SELECT least(trunc(total * 0.8::DOUBLE)::BIGINT, n_hot) AS take_hot, n_cold, total
              FROM sizes""",
        ),
        (
            "skewed",
            """SELECT q_id, v, label FROM (SELECT *, row_number() OVER (PARTITION BY hot
              ORDER BY md5('42:' || q_id), q_id) AS rn FROM held), skew
              WHERE rn <= CASE WHEN hot THEN take_hot ELSE least(total - take_hot, n_cold) END""",
        ),
        ("uniform", "SELECT q_id, v, label FROM held"),
        ("query", f"SELECT q_id, v FROM {workload}"),
        (
            "pairs",
            """SELECT q.q_id, b.vec_id, q.v AS qv, b.v AS bv,
              round(list_inner_product(b.v, q.v), 9) AS score FROM query q, base b""",
        ),
        ("top_full", _top("pairs", "q_id")),
        (
            "shards",
            """SELECT vec_id, v, (ntile(4) OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1)::INTEGER
              AS part FROM base""",
        ),
        (
            "cent",
            """SELECT label::INTEGER AS part, list(m ORDER BY dim) AS c FROM (
              SELECT label, dim, round(avg(x), 9) AS m FROM (SELECT label, unnest(v) AS x,
              generate_subscripts(v, 1) AS dim FROM base) GROUP BY label, dim) GROUP BY label""",
        ),
        (
            "assigned",
            """SELECT vec_id, v, part FROM (SELECT vec_id, v, part, row_number() OVER (PARTITION BY
              vec_id ORDER BY round(list_inner_product(v, v) + list_inner_product(c, c)
              - 2 * list_inner_product(v, c), 9), part) AS rn FROM base, cent) WHERE rn = 1""",
        ),
        (
            "cscores",
            """SELECT q_id, part, round(list_inner_product(c, v), 9) AS cscore
              FROM query, cent""",
        ),
        (
            "routes",
            f"""SELECT * FROM (SELECT q_id, part, cscore, row_number() OVER (PARTITION BY q_id
              ORDER BY cscore DESC, part)::INTEGER AS probe FROM cscores) WHERE probe <= {NPROBE}""",
        ),
        (
            "cand",
            """SELECT r.q_id, r.part, r.probe, a.vec_id, q.v AS qv, a.v AS bv,
              round(list_inner_product(a.v, q.v), 9) AS score FROM routes r
              JOIN assigned a USING (part) JOIN query q USING (q_id)""",
        ),
        ("local_ivf", _top("cand", "q_id, part", cols="part,")),
        ("top_ivf", _top("cand", "q_id", cols="part,")),
        (
            "ivf_load",
            """SELECT c.part, coalesce(n, 0)::BIGINT AS load FROM cent c LEFT JOIN
              (SELECT part, count(*) AS n FROM cand GROUP BY part) USING (part)""",
        ),
        (
            "routing",
            """SELECT c.part, coalesce(n, 0)::BIGINT AS load FROM cent c LEFT JOIN
              (SELECT part, count(*) AS n FROM routes GROUP BY part) USING (part)""",
        ),
        ("pb", f"SELECT q_id, vec_id, score, {_BLOCK_COLUMNS} FROM pairs"),
        ("cb", f"SELECT q_id, part, probe, vec_id, score, {_BLOCK_COLUMNS} FROM cand"),
        (
            "warm_rows",
            f"SELECT vec_id FROM base ORDER BY md5('42:' || vec_id), vec_id LIMIT {SAMPLE_ROWS}",
        ),
        (
            "warm_queries",
            f"SELECT q_id FROM query ORDER BY md5('42:' || q_id), q_id LIMIT {WARM_QUERIES}",
        ),
        (
            "pooled",
            f"""SELECT CASE WHEN count(*) >= {K} THEN min(score) ELSE '-infinity'::DOUBLE END AS thr
              FROM (SELECT score FROM pairs WHERE vec_id IN (SELECT vec_id FROM warm_rows)
              AND q_id IN (SELECT q_id FROM warm_queries) ORDER BY score DESC LIMIT {K})""",
        ),
        (
            "warm_thr",
            _kth(
                "(SELECT * FROM pairs WHERE vec_id IN (SELECT vec_id FROM warm_rows))",
                "score", "q_id", True,
            ),
        ),
        (
            "part_rows",
            f"""SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY part
              ORDER BY md5('42:' || vec_id), vec_id) AS rn FROM assigned)
              WHERE rn <= {SAMPLE_PER_PART}""",
        ),
        (
            "routed_kth",
            _kth(
                "(SELECT * FROM cand WHERE vec_id IN (SELECT vec_id FROM part_rows))",
                "score", "q_id", True,
            ),
        ),
        (
            "routed_thr",
            """SELECT q.q_id, coalesce(t, '-infinity'::DOUBLE) AS thr
              FROM query q LEFT JOIN routed_kth USING (q_id)""",
        ),
    ]
    return [
        *ctes,
        *_dimension_exact(),
        *_dimension_compat(),
        *_stage_compat("p0", "(SELECT *, '-infinity'::DOUBLE AS thr FROM cb)"),
        *_pipeline_exact(),
        *_pipeline_compat(),
    ]


def _counters(name: str, active: list[str], whole: str, by: str = "") -> tuple[str, str]:
    """Loads and drops per block (and ``by``) from the surviving pairs of every block."""
    sizes = " UNION ALL ".join(
        f"SELECT {by}{b} AS block, count(*) AS load FROM {a} {('GROUP BY ' + by[:-2]) if by else ''}"
        for b, a in enumerate(active)
    )
    over = f"OVER (PARTITION BY {by[:-2]} ORDER BY block)" if by else "OVER (ORDER BY block)"
    first = (
        f"(SELECT count(*) FROM {whole} w WHERE w.part = s.part)" if by
        else f"(SELECT count(*) FROM {whole})"
    )
    grid = f"(SELECT part, block FROM (SELECT DISTINCT part FROM {whole}), range({BLOCKS}) r(block))"
    filled = (
        f"(SELECT g.part, g.block, coalesce(z.load, 0) AS load FROM {grid} g LEFT JOIN ({sizes}) z "
        "ON g.part = z.part AND g.block = z.block)" if by else f"({sizes})"
    )
    return (
        name,
        f"""SELECT {by}block::INTEGER AS block, load::BIGINT AS load,
          (coalesce(lag(load) {over}, {first}) - load)::BIGINT AS pruned FROM {filled} s""",
    )


def _dimension_exact() -> list[tuple[str, str]]:
    ctes = [
        ("de0", "SELECT pb.*, coalesce(t, '-infinity'::DOUBLE) AS thr FROM pb LEFT JOIN warm_thr USING (q_id)")
    ]
    for b in range(1, BLOCKS):
        ctes.append(
            (f"de{b}", f"SELECT * FROM de{b - 1} WHERE {_optimistic(b)} >= thr - 1e-9::DOUBLE")
        )
    last = f"de{BLOCKS - 1}"
    ctes.append(("de_hits", _top(last, "q_id", _partial(BLOCKS))))
    ctes.append(_counters("de_counts", [f"de{b}" for b in range(BLOCKS)], "pb"))
    return ctes


def _dimension_compat() -> list[tuple[str, str]]:
    ctes = [("dc0", "SELECT * FROM pb")]
    for b in range(1, BLOCKS):
        ctes.append((f"dct{b}", _kth(f"dc{b - 1}", _partial(b), "q_id")))
        ctes.append(
            (
                f"dc{b}",
                f"""SELECT a.* FROM dc{b - 1} a JOIN dct{b} USING (q_id)
                  WHERE {_optimistic(b)} >= t""",
            )
        )
    ctes.append(("dc_hits", _top(f"dc{BLOCKS - 1}", "q_id", _partial(BLOCKS))))
    ctes.append(_counters("dc_counts", [f"dc{b}" for b in range(BLOCKS)], "pb"))
    return ctes


def _stage_compat(n: str, source: str) -> list[tuple[str, str]]:
    """One stage of the pipeline keyed by (q_id, part); ``source`` brings ``thr``."""
    ctes = [
        (f"{n}_in", f"SELECT * FROM {source}"),
        (f"{n}_a0", f"SELECT * FROM {n}_in WHERE {_optimistic(0)} >= thr"),
    ]
    for b in range(1, BLOCKS + 1):
        ctes.append((f"{n}_k{b}", _kth(f"{n}_a{b - 1}", _partial(b), "q_id, part")))
        kept = f"WHERE {_optimistic(b)} >= greatest(a.thr, k.t)" if b < BLOCKS else ""
        ctes.append(
            (
                f"{n}_a{b}",
                f"""SELECT a.* EXCLUDE (thr), greatest(a.thr, k.t) AS thr FROM {n}_a{b - 1} a
                  JOIN {n}_k{b} k USING (q_id, part) {kept}""",
            )
        )
    stages = " UNION ALL ".join(
        f"SELECT q_id, part, t FROM {n}_k{b}" for b in range(1, BLOCKS + 1)
    )
    ctes.append(
        (
            f"{n}_after",
            f"""SELECT i.q_id, i.part, greatest(i.thr, max(k.t)) AS thr FROM
              (SELECT DISTINCT q_id, part, thr FROM {n}_in) i LEFT JOIN ({stages}) k USING (q_id, part)
              GROUP BY i.q_id, i.part, i.thr""",
        )
    )
    ctes.append(
        (f"{n}_hits", _top(f"{n}_a{BLOCKS}", "q_id, part", _partial(BLOCKS), "part,"))
    )
    ctes.append(
        _counters(f"{n}_counts", [f"{n}_a{b}" for b in range(BLOCKS)], f"{n}_in", "part, ")
    )
    return ctes


def _stage_exact(n: str, source: str) -> list[tuple[str, str]]:
    ctes = [(f"{n}_in", f"SELECT * FROM {source}")]
    before = f"{n}_in"
    for b in range(BLOCKS):
        ctes.append(
            (f"{n}_a{b}", f"SELECT * FROM {before} WHERE {_optimistic(b)} >= thr - 1e-9::DOUBLE")
        )
        before = f"{n}_a{b}"
    ctes.append((f"{n}_hits", _top(before, "q_id, part", _partial(BLOCKS), "part,")))
    ctes.append(
        _counters(f"{n}_counts", [f"{n}_a{b}" for b in range(BLOCKS)], f"{n}_in", "part, ")
    )
    return ctes


def _merge(n: str, first: str, second: str) -> list[tuple[str, str]]:
    return [
        (
            f"{n}_hits",
            _top(
                f"(SELECT q_id, part, vec_id, score FROM {first}_hits UNION ALL "
                f"SELECT q_id, part, vec_id, score FROM {second}_hits)",
                "q_id",
                cols="part,",
            ),
        ),
        (
            f"{n}_counts",
            f"""SELECT part, block, sum(load)::BIGINT AS load, sum(pruned)::BIGINT AS pruned FROM
              (FROM {first}_counts UNION ALL FROM {second}_counts) GROUP BY part, block""",
        ),
        (
            f"{n}_blocks",
            f"""SELECT block, sum(load)::BIGINT AS load, sum(pruned)::BIGINT AS pruned
              FROM {n}_counts GROUP BY block""",
        ),
        (
            f"{n}_parts",
            f"""SELECT c.part, coalesce(n, 0)::BIGINT AS load FROM cent c LEFT JOIN
              (SELECT part, sum(load) AS n FROM {n}_counts GROUP BY part) USING (part)""",
        ),
    ]


def _pipeline_exact() -> list[tuple[str, str]]:
    return [
        *_stage_exact("x1", "(SELECT cb.*, thr FROM cb JOIN routed_thr USING (q_id) WHERE probe = 1)"),
        ("x1_kth", _kth("x1_hits", "score", "q_id", True)),
        (
            "x1_thr",
            """SELECT r.q_id, greatest(r.thr, t) AS thr FROM routed_thr r
              LEFT JOIN x1_kth USING (q_id)""",
        ),
        *_stage_exact("x2", "(SELECT cb.*, thr FROM cb JOIN x1_thr USING (q_id) WHERE probe = 2)"),
        *_merge("x", "x1", "x2"),
    ]


def _pipeline_compat() -> list[tuple[str, str]]:
    return [
        *_stage_compat("y1", "(SELECT cb.*, thr FROM cb, pooled WHERE probe = 1)"),
        ("y1_kth", _kth("y1_hits", "score", "q_id", True)),
        (
            "y1_thr",
            """SELECT q.q_id, greatest(p.thr, t, a.thr) AS thr FROM query q CROSS JOIN pooled p
              LEFT JOIN y1_kth USING (q_id) LEFT JOIN y1_after a USING (q_id)""",
        ),
        *_stage_compat("y2", "(SELECT cb.*, thr FROM cb JOIN y1_thr USING (q_id) WHERE probe = 2)"),
        *_merge("y", "y1", "y2"),
    ]


def _needed(ctes: list[tuple[str, str]], text: str) -> list[tuple[str, str]]:
    """The CTEs a statement uses, directly or through others, in order."""
    used: list[tuple[str, str]] = []
    for name, body in reversed(ctes):
        if re.search(rf"\b{name}\b", text):
            used.append((name, body))
            text += " " + body
    return used[::-1]


def _sql(select: str, ctes: list[tuple[str, str]] | None = None, workload: str = "uniform") -> str:
    chain = _needed(_search_ctes(workload) if ctes is None else ctes, select)
    if not chain:
        return select
    body = ",\n".join(f"{name} AS MATERIALIZED ({text})" for name, text in chain)
    return f"WITH {body}\n{select}"


_EVENT = [
    (
        "raw_events",
        """SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL
          ELSE '  ' || event_type || ' ' END AS label,
          CASE WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE WHEN event_id % 101 = 0 THEN 'infinity'::DOUBLE
          WHEN event_id % 103 = 0 THEN '-infinity'::DOUBLE WHEN event_id % 107 = 0 THEN NULL
          ELSE value END AS value FROM events""",
    ),
    (
        "finite_events",
        """SELECT event_id, coalesce(trim(label), 'nan') AS label,
          CASE WHEN isfinite(value) THEN value END AS value FROM raw_events""",
    ),
    ("ev", "SELECT event_id, event_type AS label FROM events"),
    *_split("ev", "ev", "event_id"),
    (
        "ev_marked",
        "SELECT event_id, label, contains(lower(label), 'error') AS hot FROM ev",
    ),
    (
        "ev_sizes",
        """SELECT least(trunc(total * 0.8::DOUBLE)::BIGINT, n_hot) AS take_hot, n_cold, total FROM
          (SELECT count(*) FILTER (hot) AS n_hot, count(*) FILTER (NOT hot) AS n_cold,
          least(5000, count(*)) AS total FROM ev_marked)""",
    ),
]

FEATURES = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")

_CODE = " ".join(f"WHEN '{flag}' THEN {i + 1}" for i, flag in enumerate(FLAGS))

_LINE = [
    (
        "li",
        """SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS vec_id,
          l_returnflag AS label FROM lineitem""",
    ),
    *_split("li", "li", "vec_id"),
    ("li_held", "SELECT vec_id, contains(lower(label), 'r') AS hot FROM li_ranked WHERE rn <= quota"),
    (
        "li_sizes",
        """SELECT n_hot, n_cold, least(5000, n_hot + n_cold) AS total FROM (SELECT
          count(*) FILTER (hot) AS n_hot, count(*) FILTER (NOT hot) AS n_cold FROM li_held)""",
    ),
    (
        "li_z",
        "SELECT l_returnflag AS label, "
        + ", ".join(
            f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem) AS {c}"
            for c in FEATURES
        )
        + " FROM lineitem",
    ),
    (
        "li_unit",
        f"SELECT label, [{', '.join(FEATURES)}] AS z, "
        f"sqrt({' + '.join(f'{c} * {c}' for c in FEATURES)}) AS len FROM li_z",
    ),
    (
        "li_mean",
        """SELECT label, dim, avg(x) AS m, count(*) AS n FROM (SELECT label,
          unnest([x / len for x in z]) AS x, generate_subscripts(z, 1) AS dim
          FROM li_unit) GROUP BY label, dim""",
    ),
    ("li_dir", "SELECT label, list(m ORDER BY dim) AS c FROM li_mean GROUP BY label"),
    (
        "li_close",
        f"""SELECT (CASE d.label {_CODE} END)::BIGINT AS q_id, row_number() OVER (PARTITION BY d.label
          ORDER BY list_inner_product(z, c) / len DESC)::INTEGER AS rk,
          round(list_inner_product(z, c) / len, 5) AS score FROM li_unit, li_dir d""",
    ),
]


def _report_rows(system: str, workload: str) -> str:
    def loads(name: str, table: str, bucket: str) -> list[str]:
        return [
            f"SELECT '{name}_load' AS metric, {bucket}::INTEGER AS bucket, load::DOUBLE AS value FROM {table}",
            f"SELECT '{name}_imbalance', -1, CASE WHEN avg(load) > 0 THEN max(load) / avg(load) ELSE 0 END FROM {table}",
        ]

    rows = ["SELECT 'queries' AS metric, -1 AS bucket, count(*)::DOUBLE AS value FROM query"]
    if system == "random":
        rows += loads(
            "shard",
            "(SELECT part, count(*) * (SELECT count(*) FROM query) AS load FROM shards GROUP BY part)",
            "part",
        )
    elif system == "cluster":
        rows += loads("shard", "ivf_load", "part")
    elif system == "dimension":
        rows += loads("block", "de_counts", "block")
        rows += ["SELECT 'pruned', block, pruned::DOUBLE FROM de_counts"]
    else:
        rows += loads("routing", "routing", "part")
        rows += loads("partition", "x_parts", "part")
        rows += loads("block", "x_blocks", "block")
        rows += ["SELECT 'pruned', block, pruned::DOUBLE FROM x_blocks"]
    body = " UNION ALL ".join(rows)
    return _sql(
        f"SELECT '{system}' AS system, '{workload}' AS workload, metric, bucket, "
        f"round(value, 6) AS value FROM ({body})",
        workload=workload,
    )


def oracle_sql() -> dict[str, str]:
    hits = "SELECT q_id, vec_id, score, rk FROM"
    part_hits = "SELECT q_id, part, vec_id, score, rk FROM"
    blocks = range(BLOCKS)
    scores = ", ".join(f"round(s{b}, 9) + 0.0 AS score_{b}" for b in blocks)
    suffixes = ", ".join(f"round(u{b}, 9) AS suffix_{b}" for b in blocks)
    bounds = ", ".join(
        f"round(u{b} - u{b + 1}, 9) AS bound_{b}" if b + 1 < BLOCKS else f"round(u{b}, 9) AS bound_{b}"
        for b in blocks
    )
    explained = "FROM top_full JOIN pb USING (q_id, vec_id)"
    z = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FEATURES)
    dims = "SELECT vec_id, unnest({}) AS x, generate_subscripts(v, 1)::INTEGER - 1 AS dim FROM emb"
    return {
        "dot_scores": _sql(
            """SELECT vec_id, round(list_inner_product(v, c), 9) AS score FROM base
              JOIN cent ON cent.part = base.label::INTEGER"""
        ),
        "full_search": _sql(f"{hits} top_full"),
        "full_search_dirty": _sql(
            f"{hits} (" + _top("(SELECT * FROM pairs WHERE vec_id % 50 <> 0)", "q_id") + ")"
        ),
        "random_shards": _sql("SELECT vec_id, part FROM shards"),
        "shard_topk": _sql(
            part_hits + " (" + _top("(SELECT p.*, part FROM pairs p JOIN shards USING (vec_id))", "q_id, part", cols="part,") + ")"
        ),
        "topk_merge": _sql(f"{part_hits} top_full JOIN shards USING (vec_id)"),
        "random_shard_search": _sql(f"{part_hits} top_full JOIN shards USING (vec_id)"),
        "shard_scan_load": _sql(
            """SELECT part, (count(*) * (SELECT count(*) FROM query))::BIGINT AS load
              FROM shards GROUP BY part"""
        ),
        "imbalance_ratio": _sql("SELECT round(max(load) / avg(load), 6) AS imbalance FROM ivf_load"),
        "mean_centroids": _sql(
            "SELECT part, unnest(c) AS x, generate_subscripts(c, 1)::INTEGER - 1 AS dim FROM cent"
        ),
        "nearest_centroid": _sql("SELECT vec_id, part FROM assigned"),
        "centroid_scores": _sql("SELECT q_id, part, cscore FROM cscores"),
        "probe_routing": _sql("SELECT q_id, part, cscore, probe FROM routes"),
        "routed_candidates": _sql(
            """SELECT r.q_id, r.part, r.probe, coalesce(n, 0)::BIGINT AS candidates FROM routes r
              LEFT JOIN (SELECT part, count(*) AS n FROM assigned GROUP BY part) USING (part)"""
        ),
        "routed_topk": _sql(f"{part_hits} local_ivf"),
        "ivf_search": _sql(f"{part_hits} top_ivf"),
        "ivf_scan_load": _sql("SELECT part, load FROM ivf_load"),
        "routing_load": _sql("SELECT part, load FROM routing"),
        "dim_blocks": _sql(
            """SELECT b::INTEGER AS block, trunc(b * (dim::DOUBLE / 7))::INTEGER AS start,
              CASE WHEN b = 6 THEN dim ELSE trunc((b + 1) * (dim::DOUBLE / 7)) END::INTEGER AS stop
              FROM (SELECT max(len(embedding)) AS dim FROM embeddings), range(7) r(b)"""
        ),
        "block_scores": _sql(f"SELECT q_id, vec_id, {scores} {explained}"),
        "block_bounds": _sql(f"SELECT q_id, vec_id, {bounds} {explained}"),
        "suffix_bounds": _sql(f"SELECT q_id, vec_id, {suffixes} {explained}"),
        "kth_threshold": _sql(
            "SELECT q_id, t AS thr FROM (" + _kth("pairs", "score", "q_id") + ")"
        ),
        "bound_filter": _sql(
            f"""SELECT q_id, vec_id FROM (SELECT l.q_id, l.vec_id, {_optimistic(2)} AS best, t
              FROM local_ivf l JOIN cb USING (q_id, vec_id)
              JOIN ({_kth("local_ivf", "score", "q_id")}) USING (q_id)) WHERE best >= t"""
        ),
        "dim_search_exact": _sql(f"{hits} de_hits"),
        "dim_search_compat": _sql(f"{hits} dc_hits"),
        "block_load": _sql("SELECT block, load FROM de_counts"),
        "block_pruned": _sql("SELECT block, pruned FROM de_counts"),
        "block_counts_compat": _sql("SELECT block, load, pruned FROM dc_counts"),
        "prewarm_pooled": _sql("SELECT thr FROM pooled"),
        "prewarm_per_query": _sql("SELECT q_id, t AS thr FROM warm_thr"),
        "prewarm_routed": _sql("SELECT q_id, t AS thr FROM routed_kth"),
        "dim_pipeline": _sql(f"{part_hits} p0_hits"),
        "dim_pipeline_thresholds": _sql("SELECT q_id, part, thr FROM p0_after"),
        "vector_pipeline": _sql(f"{part_hits} x1_hits"),
        "vector_pipeline_counts": _sql("SELECT part, block, load, pruned FROM x1_counts"),
        "probe_carry": _sql("SELECT q_id, thr FROM x1_thr"),
        "full_pipeline_exact": _sql(f"{part_hits} x_hits"),
        "full_pipeline_compat": _sql(f"{part_hits} y_hits"),
        "full_pipeline_groups": _sql(f"{part_hits} x_hits"),
        "dim_search_groups": _sql(f"{hits} de_hits"),
        "group_pairs": _sql("SELECT part, load FROM ivf_load WHERE load > 0"),
        "group_cover": _sql("SELECT part, count(*) AS n, count(*) AS covered FROM assigned GROUP BY part"),
        "pipeline_counts_exact": _sql("SELECT part, block, load, pruned FROM x_counts"),
        "pipeline_counts_compat": _sql("SELECT part, block, load, pruned FROM y_counts"),
        "partition_compute_load": _sql("SELECT part, load FROM x_parts"),
        "label_norm": _sql("SELECT event_id, label FROM finite_events", _EVENT),
        "drop_ids": "SELECT * EXCLUDE (l_orderkey, l_partkey, l_suppkey, l_shipdate) FROM lineitem",
        "numeric_only": f"SELECT {', '.join(FEATURES)} FROM lineitem",
        "nonfinite_null": _sql("SELECT event_id, value FROM finite_events", _EVENT),
        "complete_rows": _sql("SELECT * FROM finite_events WHERE value IS NOT NULL", _EVENT),
        "clean_flows": f"SELECT {', '.join(FEATURES)}, trim(l_returnflag) AS l_returnflag FROM lineitem",
        "standardise": _sql(f"SELECT label, {z} FROM li_z", _LINE),
        "l2_normalise": _sql(
            "SELECT vec_id, dim, round(CASE WHEN len > 0 THEN x / len ELSE x END, 9) + 0.0 AS x FROM "
            "(SELECT vec_id, sqrt(list_inner_product(w, w)) AS len, unnest(w) AS x, "
            "generate_subscripts(w, 1)::INTEGER - 1 AS dim FROM "
            "(SELECT vec_id, [y * label::INTEGER for y in v] AS w FROM emb))"
        ),
        "search_cast": _sql(
            "SELECT vec_id, dim, (x / 3)::FLOAT::DOUBLE AS x FROM (" + dims.format("v") + ")"
        ),
        "merge_by_name": """SELECT event_id, value, NULL::VARCHAR AS event_type FROM events
            UNION ALL SELECT event_id, NULL, event_type FROM events""",
        "stratified_split": _sql(
            "SELECT event_id, label, CASE WHEN rn <= quota THEN 'query' ELSE 'base' END AS role FROM ev_ranked",
            _EVENT,
        ),
        "split_null_label": """WITH ev AS (SELECT event_id,
              CASE WHEN event_id % 2 = 0 THEN event_type END AS label FROM events),
            sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total,
              ceil(0.1::DOUBLE * sum(count(*)) OVER ())::HUGEINT AS wanted FROM ev GROUP BY label),
            shares AS (SELECT label, wanted, (n * wanted) // total AS whole, (n * wanted) % total AS rest FROM sizes),
            quotas AS (SELECT label, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC,
              label NULLS FIRST) <= wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS quota FROM shares),
            ranked AS (SELECT *, row_number() OVER (PARTITION BY label
              ORDER BY md5('42:' || event_id), event_id) AS rn FROM ev)
            SELECT r.event_id, r.label, CASE WHEN rn <= quota THEN 'query' ELSE 'base' END AS role
            FROM ranked r JOIN quotas q ON r.label IS NOT DISTINCT FROM q.label""",
        "uniform_sample": "SELECT event_id FROM events ORDER BY md5('42:' || event_id), event_id LIMIT 5000",
        "hot_cold": _sql("SELECT event_id, hot FROM ev_marked", _EVENT),
        "skewed_sample": _sql(
            """SELECT event_id, hot FROM (SELECT *, row_number() OVER (PARTITION BY hot
              ORDER BY md5('42:' || event_id), event_id) AS rn FROM ev_marked), ev_sizes
              WHERE rn <= CASE WHEN hot THEN take_hot ELSE least(total - take_hot, n_cold) END""",
            _EVENT,
        ),
        "workload_filter": _sql("SELECT q_id, label, 'skewed' AS workload FROM skewed"),
        "vectorise_chain": _sql(
            """SELECT label, min(n)::BIGINT AS n, 5 AS dims, round(sum(m * m), 6) AS mean_square
              FROM li_mean GROUP BY label""",
            _LINE,
        ),
        "flow_search": _sql(f"SELECT q_id, rk, score FROM li_close WHERE rk <= {K}", _LINE),
        "read_flows": _sql("SELECT * FROM finite_events WHERE value IS NOT NULL", _EVENT),
        "read_flows_quoted": """SELECT event_id, event_type || ', "a"' || chr(10) || 'b ' || event_id AS label,
            value FROM events""",
        "label_export": _sql(
            """SELECT 'query' AS role, label, count(*) AS load FROM held GROUP BY label
              UNION ALL SELECT 'base', label, count(*) FROM base GROUP BY label"""
        ),
        "load_workload": _sql(f"{hits} top_full", workload="skewed"),
        "latency_summary": """SELECT event_type, count(value) AS queries, round(avg(value), 6) AS mean,
            round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
            FROM events GROUP BY event_type""",
        "latency_nonfinite": """WITH odd AS (SELECT CASE WHEN event_id % 3 <> 0 THEN event_type END
              AS event_type, CASE WHEN value < 5 THEN '-infinity'::DOUBLE WHEN value > 60
              THEN 'infinity'::DOUBLE ELSE value END AS v FROM events WHERE value IS NOT NULL),
            placed AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY v) AS rn,
              count(*) OVER (PARTITION BY event_type) AS n FROM odd),
            ends AS (SELECT event_type, n, p, p / 100 * (n - 1) - floor(p / 100 * (n - 1)) AS share,
              max(v) FILTER (rn = floor(p / 100 * (n - 1)) + 1) AS a,
              max(v) FILTER (rn = least(floor(p / 100 * (n - 1)) + 2, n)) AS b
              FROM placed, (VALUES (10::DOUBLE), (50::DOUBLE), (95::DOUBLE)) q(p) GROUP BY event_type, n, p),
            points AS (SELECT *, CASE WHEN a = b OR share = 0 THEN a ELSE a + (b - a) * share END AS x FROM ends)
            SELECT event_type, n AS queries, round(max(x) FILTER (p = 10), 6) AS p10,
              round(max(x) FILTER (p = 50), 6) AS p50, round(max(x) FILTER (p = 95), 6) AS p95
            FROM points GROUP BY event_type, n""",
        "throughput": "SELECT round(count(value) / sum(value), 9) AS qps FROM events",
        "preprocess_report": _sql(
            """SELECT * FROM (
              SELECT 'files' AS metric, 1::BIGINT AS value
              UNION ALL SELECT 'clean_rows', count(*) FROM li
              UNION ALL SELECT 'dims', 5
              UNION ALL SELECT 'base_vectors', count(*) FROM li_ranked WHERE rn > quota
              UNION ALL SELECT 'query_vectors', count(*) FROM li_held
              UNION ALL SELECT 'uniform_queries', least(5000, count(*)) FROM li_held
              UNION ALL SELECT 'skewed_queries', least(trunc(total * 0.8::DOUBLE)::BIGINT, n_hot)
                + least(total - least(trunc(total * 0.8::DOUBLE)::BIGINT, n_hot), n_cold) FROM li_sizes)""",
            _LINE,
        ),
        "run_report": "\nUNION ALL\n".join(
            f"SELECT * FROM ({_report_rows(system, workload)})"
            for workload in ("uniform", "skewed")
            for system in ("random", "cluster", "dimension", "pipeline")
        ),
    }
