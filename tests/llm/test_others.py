"""Pieces, reply trees, vectors, urls and the pipeline against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import documents, op7, op9, words
from pyspark.sql import functions as F

from quarry.llm import embed_ego, piece_samples, queries, reply_trees, simhash, url_templates

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def cuts(lat, u):
    if not u:
        return [((), 0.0)]
    return [((lat.ids[u[:j]], *rest), lat.weight[lat.ids[u[:j]]] + w) for j in range(1, len(u) + 1) if u[:j] in lat.ids for rest, w in cuts(lat, u[j:])]


def test_samples_follow_the_law_without_replacement():
    lat = piece_samples.Lattices(MODEL, 0.6)
    one, two = lat.units("the cat")
    full = {a + b: x + y for a, x in cuts(lat, one) for b, y in cuts(lat, two)}
    z = np.logaddexp.reduce(list(full.values()))
    p = {s: np.exp(w - z) for s, w in full.items()}
    n = 20_000
    got = piece_samples.sample_texts(lat, list(range(n)), ["the cat"] * n, 3, 5)
    drawn = [[tuple(ids.tolist()) for ids, *_ in row] for row in got]
    assert all(len(set(row)) == 3 for row in drawn)
    assert all(a[2] >= b[2] for row in got for a, b in zip(row, row[1:], strict=False))
    assert max(abs(lp - np.log(p[tuple(ids.tolist())])) for row in got[:200] for ids, lp, *_ in row) < 1e-9
    first, second = Counter(r[0] for r in drawn), Counter((r[0], r[1]) for r in drawn)
    third = Counter(tuple(r) for r in drawn)
    for s in sorted(p, key=p.get)[-6:]:
        assert abs(first[s] / n - p[s]) < 5 * np.sqrt(p[s] / n)
    for (a, b), c in second.most_common(5):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - want) < 5 * np.sqrt(want / n)
    for (a, b, d), c in third.most_common(5):
        want = p[a] * p[b] / (1 - p[a]) * p[d] / (1 - p[a] - p[b])
        assert abs(c / n - want) < 5 * np.sqrt(want / n)
    assert abs(np.mean([sum(np.exp(lp) / pi for _, lp, _, pi in row) for row in got]) - 1) < 0.02


def test_few_cuts_give_all_of_them():
    lat = piece_samples.Lattices(MODEL, 1.0)
    found = piece_samples.sample_texts(lat, [1, 2, None], ["a", "", "\U0001f600"], 4, 1)
    assert [len(f) for f in found][1] == 1 and found[1][0][3] == 1.0 and len(found[1][0][0]) == 0
    assert len(found[0]) == 2 and abs(sum(np.exp(x[1]) for x in found[0]) - 1) < 1e-9
    assert all(x[3] == 1.0 for x in found[0])


def test_pieces_round_trip_and_ignore_partitions(spark):
    docs = [(d, t) for d, t in documents() if t is None or "\x01" not in t]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = piece_samples.sample_pieces(df.repartition(3), MODEL, k=3)
    two = piece_samples.sample_pieces(df.coalesce(1), MODEL, k=3)
    key = ["doc_id", "sample"]
    assert one.orderBy(key).collect() == two.orderBy(key).collect()
    texts = dict(docs)
    for r in piece_samples.decode_pieces(one, MODEL).collect():
        assert r.text == (texts[r.doc_id] or "")
    assert one.groupBy("doc_id").agg(F.countDistinct("ids").alias("n"), F.count("*").alias("m")).where("n != m").count() == 0


def test_decoding_equals_the_library():
    lat = piece_samples.Lattices(MODEL, 1.0)
    r = np.random.default_rng(2)
    many = [np.empty(0, np.uint32)] + [r.integers(0, len(lat.spelled) if r.random() < 0.7 else 300, r.integers(1, 12)) for _ in range(500)] + [np.array([i]) for i in range(len(lat.spelled))]
    assert lat.decode(many) == [lat.sp.decode(ids.tolist()) for ids in many]
    assert lat.decode([]) == []


def test_pieces_query_decodes_what_it_encodes(spark, tmp_path):
    docs = [(d, t) for d, t in documents() if t is None or "\x01" not in t]
    df = spark.createDataFrame([*docs, (7, "twice"), (7, "twice"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("sample", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op1_gumbel_pieces(spark, str(tmp_path)).collect()
    texts = {d: t or "" for d, t in docs} | {7: "twice", None: "x"}
    for r in rows:
        t = texts[r.doc_id]
        assert (r.text_chars, r.text_crc32) == (len(t), zlib.crc32(t.encode())) or r.doc_id == 7
    assert len([r for r in rows if r.doc_id == 7 and r.text_chars == 5]) == 4
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op1_gumbel_pieces(spark, f"{tmp_path}/none").count() == 0


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_reply_chains(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} \\ <|end|> </s>[INST] \\| <s> \n x") for t in range(70)]
    rows += [(2, None, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 2, "sys\ntem<|", "é\U0001f600"), (None, 5, "assistant", "lost"), (3, 0, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    by = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    want = {}
    for c, turns in by.items():
        learned = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        want[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))), len(learned), sha(learned))
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op4_reply_trees(spark, str(tmp_path)).collect()}
    assert got == want


def test_reply_trees_choose_the_best_branch(spark):
    rows = [("t", 1, None, 0.0, "user", "root"), ("t", 2, 1, 1.0, "assistant", "poor"), ("t", 3, 1, 2.0, "assistant", "good"), ("t", 4, 2, 0.5, "user", "more"), ("t", 5, 99, 9.0, "user", "orphan"), ("u", 6, None, None, None, None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    best = {r.tree: [t for _, t in reply_trees.parse_turns(r.formatted)] for r in reply_trees.reply_conversations(df).collect()}
    assert best == {"t": ["orphan"], "u": [""]}
    every = {tuple(t for _, t in reply_trees.parse_turns(r.formatted)): r.score for r in reply_trees.reply_conversations(df, None).collect()}
    assert every == {("root", "poor", "more"): 1.5, ("root", "good"): 2.0, ("orphan",): 9.0, ("",): 0.0}


def best_branches(nodes, branches):
    """All paths by walking up from every leaf."""
    by = {n[1]: n for n in nodes}
    parents = {n[2] for n in nodes}
    found = defaultdict(list)
    for n in nodes:
        if n[1] in parents:
            continue
        path, at, seen = [], n[1], set()
        while at in by and at not in seen:
            seen.add(at)
            path.append(by[at])
            at = by[at][2]
        if at not in by:
            found[n[0]].append((-sum(x[3] or 0.0 for x in path), n[1], [(x[4] or "", x[5] or "") for x in path[::-1]]))
    return sorted((tree, -total, leaf, path) for tree, all_ in found.items() for total, leaf, path in sorted(all_)[:branches])


def test_forked_trees_with_ties_scores_and_cycles(spark):
    r = np.random.default_rng(11)
    nodes, n = [], 0
    for tree in range(30):
        mine = []
        for _ in range(int(r.integers(1, 40))):
            n += 1
            parent = None if not mine or r.random() < 0.05 else -n if r.random() < 0.05 else mine[int(r.integers(len(mine)))]
            nodes.append((tree, n, parent, [None, 0.0, 0.5, 1.0][int(r.integers(4))], str(r.choice(["user", "assistant"])), f"text {n}"))
            mine.append(n)
    nodes += [(40, 9001, 9003, 1.0, "user", "on"), (40, 9002, 9001, 1.0, "user", "a"), (40, 9003, 9002, 1.0, "user", "cycle"), (40, 9004, 9002, 5.0, "user", "below"), (41, 9005, 9005, 1.0, "user", "own parent"), (42, 9006, None, 1.0, "user", "root")]
    nodes += [(43, 9100 + k, 9099 + k if k else None, 1.0, "user", f"deep {k}") for k in range(37)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, score double, role string, text string").withColumn("total", F.lit("clash"))
    for branches in (1, 3, None):
        got = sorted((x.tree, x.score, x.leaf, reply_trees.parse_turns(x.formatted)) for x in reply_trees.reply_conversations(df, branches).collect())
        assert got == best_branches(nodes, branches)
    assert reply_trees.reply_conversations(df.limit(0)).count() == 0


def test_reply_chains_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op4_reply_trees(spark, str(tmp_path)).collect()] == [-7]


def test_escapes_are_reversible():
    for x in ("", "\\", "<\\|", "<|turn|>", "[INST][/INST]", "<s></s><<SYS>><</SYS>>", "<\\\\|<|\\", "<|\\|>"):
        assert reply_trees.unescape(reply_trees.escape(x)) == x
        assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", reply_trees.escape(x))


def plain_links(rows, least):
    good = {}
    for k, (i, label, v) in enumerate(rows):
        if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[k] = np.array(v, np.float32).astype(float)
    n, comp = Counter(), {k: rows[k][0] for k in range(len(rows))}
    pairs = [(a, b) for a in good for b in good if a < b and rows[a][1] == rows[b][1] and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a]) / np.sqrt(good[b] @ good[b]) >= least]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            changed = changed or comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return sorted((rows[k][0] is not None, rows[k][0] or 0, n[k], comp[k] or 0, rows[k][0] == comp[k]) for k in range(len(rows)))


def test_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 16))
    rows = []
    for i in range(420):
        v = base[i % 60] + r.normal(size=16) * r.choice([0.0, 0.05, 0.2])
        rows.append((i * 2 + 1, int(i % 3), v.astype(np.float32).tolist()))
    rows += [(2, 0, None), (4, 0, [0.0] * 16), (6, 0, [1.0, None]), (8, 0, [float("nan")] * 16), (10, 0, [float("inf")] * 16), (12, None, rows[0][2]), (14, 0, []), (16, 0, [1.0, 2.0]), (18, 0, [2.0, 4.0]), (18, 0, [2.0, 4.0]), (None, 0, rows[0][2])]
    rows += [(100_000 + i, 1, rows[1][2]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("dim", F.lit("clash")).repartition(3)
    got = sorted((x.vec_id is not None, x.vec_id or 0, x.n_links, x.component_id or 0, x.vec_id == x.component_id) for x in embed_ego.near_vectors(df).collect())
    assert got == plain_links(rows, 0.98)
    assert embed_ego.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_many_blocks(spark, monkeypatch):
    """Blocks of eight vectors: many tiles, links inside and between them, ties of the axes, one label of a third."""
    r = np.random.default_rng(13)
    base = r.normal(size=(40, 6)) * [4, 2, 1, 0, 0, 0]
    rows = [(i, int(i % 3 > 1), (base[i % 40] + r.normal(size=6) * r.choice([0.0, 0.02, 0.1])).astype(np.float32).tolist()) for i in range(700)]
    monkeypatch.setattr(embed_ego, "BLOCK", 8)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted((True, x.vec_id, x.n_links, x.component_id, x.kept) for x in embed_ego.near_vectors(df).collect())
    assert got == plain_links(rows, 0.98)


def test_ego_join_prunes_and_loses_nothing(monkeypatch):
    r = np.random.default_rng(9)
    x = r.normal(size=(900, 4)) * [3, 1, 1, 1]
    x = np.concatenate([x, x + r.normal(size=x.shape) * 0.02])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    axes = embed_ego.principal_axes(x, 2)
    eps = np.sqrt(0.04) + 1e-9
    x = x[np.lexsort(np.floor(x @ axes / eps).T[::-1])]
    w = np.ones(len(x), np.int64)
    monkeypatch.setattr(embed_ego, "SMALL", 16)
    tried = []
    visit = embed_ego.ego_join

    def spy(a, b, e, same, f):
        return visit(a, b, e, same, lambda p, q, one: (tried.append((p.hi - p.lo) * (q.hi - q.lo)), f(p, q, one)))

    monkeypatch.setattr(embed_ego, "ego_join", spy)
    cx, _, _ = embed_ego.join_blocks(x, x, w, w, axes, 0.98, True)
    monkeypatch.undo()
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    assert (cx == near.sum(axis=1)).all()


URLS = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/1?x", "http://example.org/en/12#y", "http://x.com/fr/é", "http://notcom/fr/", "http://com/de/a?b", "a://b://c/d", "http://h.org", "http://h.org?q", "http://h.org/", "HTTP://U@H.net:80//a//b/c/d/e/f/g", "http://forexample.org/es/1"]


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(0, None)]
    rows += [(1000 + i, f"http://site.net/{'bad' if i % 4 == 0 else 'good'}/{i}/p.html") for i in range(400)]
    labels = [(1000 + i, int(i % 4 != 0), 0) for i in range(0, 400, 3)] + [(1000, None, None), (5000, 0, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, marks).collect()}

    def expected(u):
        if u is None or "://" not in u:
            return "", "", None
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r, _ in url_templates.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return host, path, max(fits, key=len, default=None)

    for i, u in enumerate(URLS):
        host, path, rule = expected(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        if rule:
            assert got[i].verdict == dict(url_templates.RULES)[rule]
    assert {got[1000 + i].verdict for i in range(0, 400, 4)} == {"block"}
    assert {got[1000 + i].verdict for i in range(400) if i % 4} == {"allow"}
    assert got[1000].template == "/bad/*/*"
    assert url_templates.judge_urls(pages.limit(0), marks).count() == 0
    assert url_templates.judge_urls(pages, marks.limit(0)).where("verdict = 'block' and rule is null").count() == 0


def test_small_deep_and_numbered_branches_part_from_their_siblings(spark):
    """A section of 1.5 % of a host, one that parts at the sixth segment, and one called like a number with a word."""
    rows, labels = [], []

    def add(path, n, bad):
        for _ in range(n):
            rows.append((len(rows), f"http://big.net/{path}/{len(rows)}.html"))
            labels.append((len(rows) - 1, int(not bad), 0))

    for k in range(60):
        add(f"s{k}", 40, k == 7)
    add("blog/2024/05/12/post", 200, False)
    add("blog/2024/05/12/spam", 60, True)
    add("18plus", 50, True)
    add("/".join(["deep"] * 300), 3, False)
    pages, marks = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_templates.judge_urls(pages, marks).collect()}
    assert all((got[i].verdict == "allow") == bool(q) for i, q, _ in labels)
    assert got[7 * 40].template == "/s7/*" and any(r.template == "/blog/*/*/*/spam/*" for r in got.values())
    assert got[len(rows) - 1].template.startswith("/*/*/*/*") and got[len(rows) - 1].template.count("/") == 301


def test_urls_equal_sql(spark, sf, tmp_path):
    import duckdb

    from quarry.llm import oracles

    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    got = queries.op10_url_templates(spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.urls()})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_urls_stay_native(spark, sf):
    plan = queries.op10_url_templates(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    one = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r.doc_id for r in one.collect()}
    assert all(d not in kept for d, t in texts.items() if op7(t)[5])
    two = corpus_pipeline.near_dedup(spark, one, sf)
    left = {r.doc_id: r.text for r in two.collect()}
    sets = {}
    for d in kept:
        w = [x.lower() for x in words(texts[d])]
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    ids = sorted(kept)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                assert b not in left
    assert all(any(len(sets[a] & sets[d]) >= 0.5 * len(sets[a] | sets[d]) for a in ids if a != d) for d in kept - set(left))
    three = corpus_pipeline.substring_dedup(spark, two, sf)
    want = op9(sorted(left.items()))
    for r in three.collect():
        n, gone, digest = want[r.doc_id]
        assert r.text == left[r.doc_id] if not gone else sha(r.text) == digest
    four = corpus_pipeline.secret_scan(spark, three, sf)
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == set(left)


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    none = write(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, none).count() == 0


def test_pipeline_tells_rows_of_equal_ids_apart(spark, tmp_path):
    """Null and repeated ids, equal rows, near copies, a shared passage, a secret, columns with clashing names."""
    import corpus_pipeline

    r = np.random.default_rng(21)
    fresh = lambda n: list(r.choice([f"word{i}" for i in range(9000)], n))
    one, two, three, passage = fresh(120), fresh(150), fresh(90), fresh(60)
    near = one.copy()
    near[60] = "edited"
    rows = [(1, one, "a"), (1, near, "b"), (1, two, "c"), (1, two, "c"), (None, three, "d"), (None, three, "d"), (2, fresh(100) + passage, "e"), (2, passage + fresh(100), "f"), (3, fresh(70) + ["password=hunter22"], "g"), (4, ["too", "short"], "h"), (5, [], "i")]
    data = [(i, " ".join(w), k, k, 7, "x", 1) for i, w, k in rows] + [(6, None, "j", "j", 0, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, k string, shard int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    left = docs
    for name, want in (("quality rules", "abccddefg"), ("SimHash near-dedup", None), ("substring dedup", None), ("secret scans", None)):
        left = stages[name](spark, left, str(tmp_path))
        assert left.columns == docs.columns
        got = "".join(sorted(x.lang for x in left.collect()))
        assert got == want if want else got in ("acdefg", "bcdefg"), name
    texts = {x.lang: x.text for x in left.collect()}
    assert sum(" ".join(passage) in t for t in texts.values()) == 1 and "[REDACTED]" in texts["g"] and "hunter22" not in texts["g"]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(x.start == 0 for x in pieces) == 6 and {x.doc_id for x in pieces} == {1, 2, 3, None}


@pytest.mark.parametrize("a, b", [("x " * 3, "x x x"), ("", "y")])
def test_similarity_of_short_texts(a, b):
    p, q = simhash.views(a, 5)[2], simhash.views(b, 5)[2]
    assert simhash.similarity(p, q) == (1.0 if a.split() == b.split() else 0.0)
