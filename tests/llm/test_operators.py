"""Every operator on awkward rows, against brute force; and on an empty table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import exact_dedup, html_text, line_templates, mixing, near_dedup, nearest_tiles, packing, secrets, substring_dedup, toxicity
from tests.llm.data import documents, empty, prose

SPACE = re.compile(r"[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def _key(k):
    return (k is None, k or 0)


def _bag(text):
    w = [x for x in SPACE.split(text) if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def _classes(rows):
    """Class of every row by all pairs."""
    bags, root = [_bag(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_near_dedup(docs, rows):
    root = _classes(rows)
    want = []
    for (k, _), r in zip(rows, root):
        members = [m for (m, _), q in zip(rows, root) if q == r]
        want.append((k, min(members, key=_key), len(members)))
    got = [tuple(r) for r in near_dedup.classes(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_dedup_keeps_one_row_of_each_class(docs, rows):
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns and {r["__node"] for r in kept.select("__node").collect()} == {"clash"}
    kept = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    root = dict(zip(rows, _classes(rows)))
    assert sorted(root[r] for r in kept) == sorted(set(root.values()))
    for k, t in kept:
        assert k == min((m for (m, u), q in root.items() if q == root[k, t]), key=_key)


def test_a_crowded_bucket_is_completed(spark, monkeypatch):
    """Many variants of one text, most of them too far from any pivot: classes are still those of all pairs."""
    monkeypatch.setattr(near_dedup, "TILE", 8)
    monkeypatch.setattr(near_dedup, "SALT_EVERY", 5)
    base = prose(3, 90).split()
    rows = []
    for i in range(60):
        words = list(base)
        for e in range(i % 6):
            words[(i * 7 + e * 13) % 90] = f"edit{i}x{e}"
        rows.append((i, " ".join(words)))
    got = {r[0]: r[1] for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = _classes(rows)
    first = {r: min(k for (k, _), q in zip(rows, root) if q == r) for r in root}
    assert got == {k: first[r] for (k, _), r in zip(rows, root)}


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = [(k, np.array(whole.encode(t, add_special_tokens=False).ids + [2], "<u4")) for k, t in rows]
    pieces = packing.pack(docs).toPandas()
    wanted = collections.Counter()
    for k, x in ids:
        wanted[None if k is None else float(k), len(x)] += len(x)
    got = collections.Counter()
    for r in pieces.itertuples():
        k = None if r.doc_id != r.doc_id else float(r.doc_id)
        got[k, r.doc_tokens] += r.length
        same = [x for i, x in ids if (None if i is None else float(i)) == k and len(x) == r.doc_tokens]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in same)
    assert got == wanted
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        ends = (g.offset + g.length).tolist()
        assert g.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 4096
    assert pieces.length.sum() > 0.9 * 4096 * (pieces.sequence_id.nunique() - 1)


def test_packing_cuts_texts_longer_than_a_sequence(spark):
    docs = spark.createDataFrame([(i, prose(i, n)) for i, n in enumerate([9000, 3, 500, 700, 40, 2000, 90, 5000])], "doc_id long, text string")
    p = packing.pack(docs, capacity=512, unit=8, short=16, share=0.3).toPandas().sort_values(["doc_id", "start"])
    for _, g in p.groupby("doc_id"):
        assert g.start.tolist() == [0, *(g.start + g.length).tolist()[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]
    used = p.groupby("sequence_id").length.sum()
    assert used.max() <= 512 and used.sum() > 0.97 * 512 * len(used)


def _line_templates(rows, least=3):
    """Kept text of every row, by counting."""

    def tokens(line):
        return tuple("*" if re.search("[0-9]", t) else t for t in SPACE.split(line) if t)

    def leaf(t):
        return len(t), t[:3]

    distinct = list(dict.fromkeys(rows))
    reach, seen, having = (collections.defaultdict(set) for _ in range(3))
    for r in distinct:
        for t in {tokens(x) for x in r[1].split("\n")}:
            if len(t) >= 5:
                reach[leaf(t)].add(r)
                for i, x in enumerate(t):
                    seen[leaf(t), i, x].add((r, t))

    def template(t):
        if len(t) < 5 or len(reach[leaf(t)]) < least:
            return None
        fixed = tuple(x if x != "*" and len(seen[leaf(t), i, x]) >= least else None for i, x in enumerate(t))
        return (leaf(t), fixed) if sum(x is not None for x in fixed) >= 0.6 * len(t) else None

    for r in distinct:
        for x in r[1].split("\n"):
            having[template(tokens(x))].add(r)
    out = []
    for r in rows:
        lines = []
        for x in r[1].split("\n"):
            m = template(tokens(x))
            first = m and min(having[m], key=lambda q: _key(q[0]))
            if not (m and len(having[m]) >= least and first != r):
                lines.append(x)
        out.append("\n".join(lines))
    return out


def test_line_templates(spark):
    shared = ["This page was seen 17 times today", "All rights are reserved by the authors", "short line"]
    rows = [(i, "\n".join([prose(i, 30), *[s.replace("17", str(i * 3)) for s in shared], prose(50 + i, 9)])) for i in range(1, 8)]
    rows += [(8, "Left alone because only two documents have it"), (9, "Left alone because only two documents have it"), (None, rows[0][1]), (None, ""), (3, rows[2][1])]
    df = spark.createDataFrame([(k, t, "keep", 5) for k, t in rows] + [(20, None, "keep", 5)], "doc_id long, text string, __gone string, n_lines int")
    out = line_templates.drop_recurring(df)
    assert out.columns == ["doc_id", "text", "__gone", "n_lines", "n_dropped"]
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == collections.Counter(zip([k for k, _ in rows], _line_templates(rows))) + collections.Counter([(20, None)])
    lost = {r["doc_id"]: r["n_dropped"] for r in out.collect()}
    assert lost[1] == 0 and lost[2] == 2 and lost[8] == 0


@pytest.mark.parametrize("size", [60, 600])
def test_a_template_recurs_at_any_size(spark, size):
    """Two word fields of 20 values each: their combinations are rare at one size and values frequent at the other."""
    rng = np.random.default_rng(size)
    line = lambda i: f"Visit was made by n{'abcdefghijklmnopqrst'[rng.integers(20)]} to the town of t{'abcdefghijklmnopqrst'[rng.integers(20)]} as noted here"
    rows = [(i, f"{prose(i, 20)}\n{line(i)}\nVisit was made by somebody who came {prose(5000 + i, 4)}") for i in range(size)]
    out = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: "as noted here" in r["text"] for r in out} == {i: i == 0 for i in range(size)}


def test_long_and_short_lines_recur_verbatim(spark):
    passage, fewer = prose(77, 55), prose(78, 40)
    rows = [(i, "\n".join([prose(i, 20), *([passage, fewer] if i in (3, 6) else []), "All rights reserved.", *(["two words"] if i < 8 else [])])) for i in range(9)]
    out = line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lines = {r["doc_id"]: r["text"].split("\n") for r in out}
    having = lambda x: [i for i in range(9) if x in lines[i]]
    assert having(passage) == [3] and having(fewer) == [3, 6] and having("All rights reserved.") == [0] and having("two words") == list(range(8))
    assert {r["doc_id"]: r["n_dropped"] for r in out} == {i: (i > 0) + (i == 6) for i in range(9)}


def test_html(spark):
    page = "<html><body><nav><a href=/>x</a></nav><article><h1>T</h1><p>Some words of text here.</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", page, "clash"), (1, "u", page, "clash"), (2, None, None, "c"), (None, "v", "", "c"), (3, "w", "<p>" + "y " * 200_000, "c")],
                               "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, "u", "T Some words of text here.", 26)] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", ("y " * 200_000).strip(), 399_999)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def _base_spans(text):
    a, k, h = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    spans = [(m.start(), 1, m.end(), "assign") for m in a.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 2, m.end(), "access") for m in k.finditer(text) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 3, m.end(), "hex") for m in h.finditer(text) if len(m[0]) >= 24])


def test_secrets(spark, docs, rows):
    rng = np.random.default_rng(8)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    random = [draw(secrets.ALPHABETS["base64"], 40) for _ in range(40)]
    texts = ["é secret:token:abcdefgh PASSWORD = 'abc' Api_Key=\"a.b-c_d/e\"", "x AKIA" + "Z9" * 9 + " AKIAKIA1", "0" * 23 + " " + "0123456789abcdef" * 3 + "g" + "f" * 24]
    texts += [f"{prose(i, 5)} {r} {prose(i, 3)}" for i, r in enumerate(random)] + ["thisisnotA1secretbutalongordinarywordwithoutanything" * 3]
    df = docs.select("doc_id", "text", "score").union(spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string"))
    got = collections.Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"] if s["kind"] != "random")) for r in secrets.scan(df).collect())
    want = rows + [(100 + i, t) for i, t in enumerate(texts)]
    assert got == collections.Counter((k, tuple(_base_spans(t))) for k, t in want)
    found = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == "random"] for r in secrets.scan(df).collect()}
    caught = [any(texts[i + 3][s["start"] : s["end"]] == random[i] for s in found[103 + i]) for i in range(40)]
    assert sum(caught) >= 30 and not found[1] and not found[7]
    assert secrets.scan(df.limit(0)).count() == 0


def test_copies_of_a_string_move_no_threshold(spark):
    rng = np.random.default_rng(9)
    random = ["".join(rng.choice(list(secrets.ALPHABETS["base64"]), 40)) for _ in range(120)]
    ordinary = ["Aa1" + f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 18 + "b" for i in range(400)]
    once = random + ordinary
    p = {r["found"]: r["p"] for r in secrets.tested(spark.createDataFrame([("random", x) for x in random], "kind string, found string")).collect() if r["p"]}
    copied = min(p, key=lambda x: abs(p[x] - 0.65))

    def spans(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r["doc_id"]: len([s for s in r["spans"] if s["kind"] == "random"]) for r in secrets.scan(df).collect()}

    few, many = spans(once), spans(once + [copied] * 3000)
    assert {i: many[i] for i in few} == few and sum(few[i] for i in range(120)) >= 90 and sum(few.values()) < 140
    assert all(many[i] == 1 for i in range(len(once), len(once) + 3000))


def _levels(sizes, weights, most):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("whole", [False, True])
def test_mixing(docs, rows, whole):
    mixed = [r.asDict() for r in mixing.mix(docs, whole=whole).collect()]
    assert len(mixed) == len(rows)
    sizes = collections.Counter()
    for r in mixed:
        sizes[r["source"]] += r["size"]
    assert sorted(r["size"] for r in mixed) == sorted(len([x for x in SPACE.split(t) if x]) for _, t in rows)
    target = _levels(sizes, (1, 2, 3), 3)
    taken = collections.Counter()
    for r in mixed:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and (not whole or r["taken"] % max(1, r["size"]) == 0)
        taken[r["source"]] += r["taken"]
    largest = {s: max(r["size"] for r in mixed if r["source"] == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= (largest[s] if whole else 0.5)
    again = sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.mix(docs.repartition(7), whole=whole).select("doc_id", "size", "taken").collect())
    assert again == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixed)


def test_toxicity(spark):
    toxic = ["dreadful", "hideous", "vile"]
    rows = [(i, prose(i, 40) + (f" {toxic[i % 3]} you {toxic[(i + 1) % 3]}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame([(k, t, "clash") for k, t, _ in rows] + [(None, None, "c"), (900, "", "c"), (901, "w " * 100_000, "c"), (1, rows[1][1], "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.classify(df, labels).withColumn("held_out", toxicity.held_out("doc_id")).collect()
    assert len(out) == 404 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    label = {k: y for k, _, y in rows}
    tested = [r for r in out if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in tested]) > 0.95
    none = toxicity.classify(df.limit(3), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and toxicity.classify(df.limit(0), labels).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(100, rows[5][1])]
    odd = [(400, None), (401, [0.0] * 6), (500, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (501, [float("nan")] * 6), (502, [float("inf")] + [0.0] * 5), (None, rows[1][1]), (600, [1.0, 2.0]), (601, [1.0, 3.0])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows + odd], "vec_id long, embedding array<float>, score string").repartition(5)
    got = [tuple(r) for r in nearest_tiles.nearest(df, F.col("vec_id") % 100 == 0, rows_per_block=16, blocks_per_group=2).collect()]
    want = []
    for q, v in rows:
        if q % 100 == 0:
            far = []
            for k, u in rows:
                if k != q:
                    total = 0.0
                    for a, b in zip(v, u):
                        total += (a - b) * (a - b)
                    far.append((total**0.5, k))
            want += [(q, i + 1, k, d) for i, (d, k) in enumerate(sorted(far)[:10])]
    want.append((600, 1, 601, 1.0))
    assert [r[:3] for r in sorted(got)] == [r[:3] for r in sorted(want)]
    assert [r[3] for r in sorted(got)] == pytest.approx([r[3] for r in sorted(want)], rel=1e-14)
    assert nearest_tiles.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_substring_dedup(spark, docs, rows, monkeypatch):
    shared = prose(77, 60)
    extra = [(20 + i, f"{prose(100 + i, 20)} {shared[i:]} {prose(200 + i, 20)}") for i in range(12)] + [(40, "é" * 40), (41, "é" * 40), (42, "a" * 49), (43, "a" * 49)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    every = sorted(rows + extra, key=lambda r: _key(r[0]))
    first, want = {}, []
    for k, t in every:
        raw = t.encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], _key(k))
    for k, t in every:
        raw = t.encode()
        cover = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < _key(k):
                cover[i : i + 50] = True
        left = bytes(b for b, c in zip(raw, cover) if not c)
        spans = int((cover[:-1] & ~np.concatenate([[False], cover[:-2]])).sum()) if len(raw) else 0
        want.append((k, len(raw), int(cover.sum()), spans, hashlib.sha256(left).hexdigest()))
    for blocks in (1 << 20, 3000):
        out = substring_dedup.cut_repeats(df, block_bytes=blocks, shard_bytes=20_000)
        got = [tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, rows, tmp_path, weak):
    path = str(tmp_path / "docs.parquet")
    docs.repartition(4).write.parquet(path)
    digest = (lambda c: F.substring(F.md5(c), 1, 1)) if weak else exact_dedup.sha256
    got = [tuple(r) for r in exact_dedup.deduplicate(docs.sparkSession, path, digest=digest, files_per_batch=2).collect()]
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[SPACE.sub(" ", t)].append(k)
    want = [(k, min(groups[SPACE.sub(" ", t)], key=_key), len(groups[SPACE.sub(" ", t)]), hashlib.sha256(SPACE.sub(" ", t).encode()).hexdigest()) for k, t in rows]
    assert sorted(((g[0], g[1], g[2], g[4]) for g in got), key=str) == sorted(want, key=str)
    assert sum(g[3] for g in got) == len(groups) and all(g[0] == g[1] for g in got if g[3])


def test_empty_tables(spark, tmp_path):
    none = empty(spark)
    for out in (
        near_dedup.classes(none), near_dedup.representatives(none), packing.pack(none), line_templates.drop_recurring(none),
        mixing.mix(none), substring_dedup.cut_repeats(none),
    ):
        assert out.count() == 0
    path = str(tmp_path / "empty.parquet")
    none.write.parquet(path)
    assert exact_dedup.deduplicate(spark, path).count() == 0


def test_pipeline_keeps_what_it_should(spark, tmp_path):
    toxic = ["dreadful", "hideous", "vile"]
    boiler = "All rights are reserved by the authors of this text"
    rows = []
    for i in range(300):
        text = prose(i, 60) + "\n" + (boiler if i % 3 == 0 else prose(1000 + i, 12))
        rows.append((i, text + (f" {toxic[i % 3]} {toxic[(i + 1) % 3]}" if i % 6 == 0 else ""), "en", f"s{i % 3}", len(text)))
    rows += [(400, rows[7][1], "en", "s0", 0), (401, rows[8][1] + " end", "en", "s1", 0), (402, None, "en", None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    clean = {i for i in range(300) if i % 6} | {400, 401, 402}
    assert clean <= set(seen[0]) | set() and len(set(seen[0]) - clean) <= 2
    assert [i for i, t in seen[1].items() if t and boiler in t] == [min(i for i in seen[0] if i % 3 == 0 and i < 300)]
    assert {400, 401}.isdisjoint(seen[2]) and {7, 8} <= set(seen[2]) and set(seen[0]) - set(seen[2]) == {400, 401}
    assert set(seen[3]) <= set(seen[2])
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(seen[3])
