"""Line and substring dedup, fingerprints, near copies and the classifier against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import bytes_kernel as K
from lakeloom.llm import line_dedup, near_dedup, quality_cnn, repeats, spotsigs, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, id string, a int, c0 string, n bigint, _text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 3, None, 4, "y") for i, t in rows], SCHEMA)


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))


def prose(r, n):
    return " ".join(r.choice(["the", "of", "is", "and", word(r), word(r), word(r)]) for _ in range(n))


def edited(r, text, rate=0.03):
    return " ".join(word(r) if r.random() < rate else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    """Unrelated prose, copies, near copies in one hot group and small ones, shared passages and odd texts."""
    r = random.Random(5)
    base = [prose(r, r.randint(60, 300)) for _ in range(120)]
    rows = list(enumerate(base))
    rows += [(1000 + i, edited(r, base[i % 10])) for i in range(40)]
    rows += [(2000 + i, edited(r, base[0], 0.02)) for i in range(300)]
    rows += [(3000 + i, base[7]) for i in range(30)]
    passage = prose(r, 60)
    rows += [(4000 + i, f"{prose(r, 150)} {passage} {prose(r, 150)}") for i in range(10)]
    rows += [(5000, None), (5001, ""), (5002, " \n "), (5003, "!!! ..."), (5004, "word"), (5005, "word"), (5006, base[3].upper()), (None, base[3]), (5007, prose(r, 60000))]
    r.shuffle(rows)
    return rows


# --- kernels


def test_kernels_agree_with_python():
    r = random.Random(1)
    texts = ["", "É à, the-Thing 12x", "a", "", prose(r, 50), "日本 語"]
    data, offs = K.flat(pa.array([*texts, None]))
    h, doc, first = K.words(data, offs)
    import re

    split = [re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()) for t in [*texts, ""]]
    assert np.diff(first).tolist() == [len(s) for s in split]
    flat_words = [w for s in split for w in s]
    for i, w in enumerate(flat_words):
        assert int(h[i]) == K.word_hash(w.decode(errors="surrogateescape")) if w.isascii() else True
        for j in range(i):
            assert (h[i] == h[j]) == (w == flat_words[j])
    raw = bytes(r.randrange(256) for _ in range(500))
    g, x = K.GEAR.astype(np.uint16), 0
    got = K.gear16(np.frombuffer(raw, np.uint8))
    for i, c in enumerate(raw):
        x = ((x << 1) + int(g[c])) & 0xFFFF
        assert x == got[i]
    spans = [(a, b) for a in range(0, 60, 7) for b in range(a, 60, 5)]
    p = K.PrefixHash(np.frombuffer(raw[:30] * 2, np.uint8))
    hs = p.of(np.array([a for a, _ in spans]), np.array([b for _, b in spans]))
    for i, (a, b) in enumerate(spans):
        for j, (c, d) in enumerate(spans):
            assert (hs[i] == hs[j]) == ((raw[:30] * 2)[a:b] == (raw[:30] * 2)[c:d])


def test_blocks_do_not_change_results(corpus):
    data, offs = K.flat(pa.array([t for _, t in corpus]))
    whole = [x for _, _, d, o in K.blocks(data, offs, 1 << 30) for x in _per_doc(d, o)]
    small = [x for _, _, d, o in K.blocks(data, offs, 500) for x in _per_doc(d, o)]
    assert whole == small


def _per_doc(d, o):
    s, e = substring_dedup.chunk_bounds(d, o)
    c = line_dedup.line_chunks(d, o)
    spot, doc = spotsigs.spots(d, o)
    out = []
    for k in range(len(o) - 1):
        mine = (s >= o[k]) & (s < o[k + 1])
        out.append(((s[mine] - o[k]).tolist(), (e[mine] - o[k]).tolist(), (c["start"][c["doc"] == k] - o[k]).tolist(), c["a"][c["doc"] == k].tolist(), spot[doc == k].tolist()))
    return out


# --- line dedup


def test_line_runs_equal_brute_force(spark):
    r = random.Random(9)
    pool = [prose(r, 8) for _ in range(400)] + ["", " "]
    block = pool[:30]
    rows = []
    for i in range(60):
        k = r.randint(0, 26)
        passage = block[k : k + r.randint(2, 4)] if i % 3 == 0 else []
        rows.append((i, "\n".join([r.choice(pool) for _ in range(r.randint(0, 6))] + passage + [prose(r, 5)])))
    rows += [(100, rows[0][1]), (101, rows[0][1] + "\n"), (102, None), (103, ""), (104, "\n\n"), (None, rows[0][1]), (105, "solo\n"), (106, "\n".join(block * 30)), (107, "a\na\na\na\na"), (108, "x y\n\n\n\nz"), (109, "x y\n\n\n\nz")]
    r.shuffle(rows)
    lines = {i: t.split("\n")[: -1 if t.endswith("\n") else None] for i, t in rows if i is not None and t}
    # every earlier, not overlapping place of every run of two or more lines
    places = [(i, k) for i in sorted(lines) for k in range(len(lines[i]))]
    at = defaultdict(list)
    for i, k in places:
        at[lines[i][k]].append((i, k))
    gone = defaultdict(set)
    for i, k in places:
        for j, m in at[lines[i][k]]:
            n = 0
            while (j, m + n) < (i, k) and k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n]:
                n += 1
            for x in range(k, k + n - 1):
                if (lines[i][x] + lines[i][x + 1]).strip():
                    gone[i] |= {x, x + 1}
    want = {}
    for i, t in rows:
        cut = gone[i] if i is not None else set()
        text = "".join(x for k, x in enumerate(t.splitlines(keepends=True)) if k not in cut) if cut else t
        if not cut or text.strip():
            want[i] = (text, len(cut))
    df = frame(spark, rows)
    out = line_dedup.dedup_line_runs(df)
    assert out.columns == [*df.columns, "removed_lines"]
    assert {x.doc_id: (x.text, x.removed_lines) for x in out.collect()} == want
    assert 100 not in want and 101 not in want and want[107] == ("a\na\n", 3)
    assert sum(n > 0 for _, n in want.values()) > 10
    assert line_dedup.dedup_line_runs(frame(spark, [])).collect() == []
    shared = [(1, "p q\nr s"), (2, "p q\nr s\nt"), (2, "u v\nw x\ny"), (2, None)]
    assert {(x.text, x.removed_lines) for x in line_dedup.dedup_line_runs(frame(spark, shared)).collect()} == {("p q\nr s", 0), ("t", 2), ("u v\nw x\ny", 0), (None, 0)}


def test_op2_removes_every_repeated_run(spark):
    from lakeloom.llm import queries

    d = "/root/testdata/sf0.001"
    docs = {x.doc_id: x.text.encode().split(b"\n") for x in spark.read.parquet(f"{d}/documents.parquet").filter("text <> ''").collect()}
    seen, again = set(), 0
    for i in sorted(docs):
        pairs = list(zip(docs[i], docs[i][1:], strict=False))
        again += len({x for k, p in enumerate(pairs) if p in seen for x in (k, k + 1)})
        seen |= set(pairs)
    left = {x.doc_id: x.removed_lines for x in queries.op2_line_dedup(spark, d).select("doc_id", "removed_lines").collect()}
    assert sum(left.values()) + sum(len(docs[i]) for i in docs if i not in left) >= again > 0


# --- substring dedup


def test_substring_dedup_equals_brute_force(spark, corpus):
    ids = {}
    for i, t in corpus:
        if i is not None and t:
            ids[i] = t.encode()
    spans, first = {}, {}
    for i in sorted(ids):
        d = np.frombuffer(ids[i], np.uint8)
        s, e = substring_dedup.chunk_bounds(d, np.array([0, len(d)]))
        assert b"".join(ids[i][a:b] for a, b in zip(s, e, strict=True)) == ids[i]
        spans[i] = [(int(a), int(b)) for a, b in zip(s, e, strict=True)]
        for a, b in spans[i]:
            first.setdefault(ids[i][a:b], (i, a))
    got = {x.doc_id: x for x in substring_dedup.dedup_substrings(frame(spark, corpus)).collect()}
    assert len(got) == len(corpus)
    for i, t in corpus:
        if i is None or not t:
            assert got[i].text == t and got[i].removed_bytes == 0
            continue
        again = [(a, b - a) for a, b in spans[i] if first[ids[i][a:b]] != (i, a)]
        gone = substring_dedup.runs(again, len(ids[i]))
        keep, at = b"", 0
        for a, b in gone:
            keep, at = keep + ids[i][at:a], b
        assert got[i].text.encode() == keep + ids[i][at:]
        assert got[i].removed_bytes == sum(b - a for a, b in gone)
    # a shared passage of 60 words is found, unrelated text is left alone
    assert sum(got[4000 + i].removed_bytes > 0 for i in range(10)) == 9
    assert all(got[i].removed_bytes == 0 for i in range(120))
    assert all(got[3000 + i].text == "" for i in range(30))
    assert substring_dedup.dedup_substrings(frame(spark, [])).collect() == []


def test_unequal_texts_are_kept_whatever_their_polynomial_hashes(spark):
    """A Thue-Morse word and its complement collide in polynomial hashes modulo 2**64."""
    for x, y in ("az", "bq", "ce"):
        word = "".join(x if bin(i).count("1") % 2 == 0 else y for i in range(1024))
        other = word.translate(str.maketrans(x + y, y + x))
        if x == "a":  # others have repeated substrings
            rows = [(1, word), (2, other), (3, word)]
            assert {r.doc_id: r.text for r in substring_dedup.dedup_substrings(frame(spark, rows)).collect()} == {1: word, 2: other, 3: ""}
        lines = [(1, f"{word}\nx"), (2, f"{other}\nx"), (3, f"{word}\nx\ny")]
        assert {r.doc_id: r.text for r in line_dedup.dedup_line_runs(frame(spark, lines)).collect()} == {1: f"{word}\nx", 2: f"{other}\nx", 3: "y"}


@pytest.mark.parametrize("op", ["lines", "substrings"])
def test_odd_columns_ids_and_hot_texts(spark, op):
    hot = "the same long line of text, one\nthe same long line of text, two\n" * 3
    rows = [(f"d{i:04}", hot + f"own {i}", ("x", [1])) for i in range(300)] + [("short", "tiny", None), ("short2", "tiny", None)]
    df = spark.createDataFrame(rows, "`my.id` string, Text string, `a b` struct<`c d`: string, e: array<int>>")
    df = df.withColumn("Removed_Lines", F.lit(7)).withColumn("REMOVED_BYTES", F.lit("x")).withColumn("c0", F.lit(1)).withColumn("_text", F.lit(2))
    f = {"lines": line_dedup.dedup_line_runs, "substrings": substring_dedup.dedup_substrings}[op]
    out = f(df, "my.id", "text")
    got = {r[0]: r for r in out.collect()}
    if op == "lines":
        assert out.columns == ["my.id", "Text", "a b", "REMOVED_BYTES", "c0", "_text", "removed_lines"]
        assert got["d0000"][1] == hot[: len(hot) // 3] + "own 0" and all(got[f"d{i:04}"][1] == f"own {i}" for i in range(1, 300))
        assert got["short2"][1] == "tiny"
    else:
        assert out.columns == ["my.id", "Text", "a b", "Removed_Lines", "c0", "_text", "removed_bytes", "repeated_from"]
        assert all(len(got[f"d{i:04}"][1]) < 100 for i in range(1, 300))
        assert (got["short"][1], got["short2"][1], got["short2"].removed_bytes, got["short2"].repeated_from) == ("tiny", "", 4, ["short"])
    assert got["d0007"][2] == ("x", [1]) and got["d0007"]["c0"] == 1 and got["d0007"]["_text"] == 2
    f(df, "my.id", "text").limit(0).write.format("noop").mode("overwrite").save()


def test_bitmap_of_repeats(spark):
    r = np.random.default_rng(5)
    h = r.integers(-(2**63), 2**63 - 1, 3000)
    df = spark.createDataFrame(pa.table({"h": np.concatenate([h, h[:500], h[:10]])}))
    bits = repeats.repeated(df, bits=18)
    assert repeats.maybe(bits, h[:500]).all() and repeats.maybe(bits, h[500:]).mean() < 0.01
    assert np.unpackbits(bits).sum() <= 500
    assert not repeats.repeated(df.limit(0), bits=10).any()


def test_chunks_resist_insertions():
    r = random.Random(4)
    text = prose(r, 2000).encode()
    cut = lambda x: {x[a:b] for a, b in zip(*substring_dedup.chunk_bounds(np.frombuffer(x, np.uint8), np.array([0, len(x)])), strict=True)}
    assert len(cut(text) - cut(text[:5000] + b"inserted" + text[5000:])) <= 3
    long = "é".encode() * 5000
    assert all(x.decode() for x in cut(long)) and max(map(len, cut(long))) <= substring_dedup.MAX_CHUNK + 3


# --- pairs


def jaccards(sets, least):
    inv, both = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for x in s:
            inv[x].append(i)
    for v in inv.values():
        for a in range(len(v)):
            for b in range(a):
                both[min(v[a], v[b]), max(v[a], v[b])] += 1
    out = {}
    for (a, b), n in both.items():
        j = n / (len(sets[a]) + len(sets[b]) - n)
        if j >= least:
            out[a, b] = j
    return out


def classes_of(rows):
    """class of each id, and links of each class, by brute force."""
    whole, sets = {}, {}
    for i, t in rows:
        if i is not None and t:
            d = np.frombuffer(t.encode(), np.uint8)
            s = frozenset(spotsigs.spots(d, np.array([0, len(d)]))[0].tolist())
            whole[i] = s or t
    rep = {}
    for i in sorted(whole):
        rep.setdefault(whole[i], i)
    sets = {i: s for s, i in rep.items() if not isinstance(s, str)}
    true = jaccards(sets, 0.5)
    links = defaultdict(int)
    for a, b in true:
        links[a] += 1
        links[b] += 1
    return {i: (rep[s], links[rep[s]]) for i, s in whole.items()}, true


def test_spotsigs_equal_brute_force(spark, corpus):
    want, pairs = classes_of(corpus)
    df = frame(spark, corpus)
    got = [(x.doc_id, (x.class_id, x.links)) for x in spotsigs.fingerprint_classes(df).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert sum(n for _, n in want.values()) > 1000 and sum(i != c for i, (c, _) in want.items()) >= 30
    got = {(x.id_a, x.id_b): x.jaccard for x in spotsigs.class_pairs(df).collect()}
    assert got.keys() == pairs.keys() and all(abs(got[k] - pairs[k]) < 1e-12 for k in got)
    assert spotsigs.fingerprint_classes(frame(spark, [])).collect() == []


def test_spotsigs_equal_sql_and_odd_rows(spark):
    import duckdb

    from lakeloom.llm import oracle

    few, none = "the red fox, a blue whale", "item 7; item 9"
    docs = [(1, few), (2, few), (3, "the red fox"), (4, none), (5, none), (6, none.upper()), (7, None), (8, None), (9, ""), (10, ""), (11, "was here now"), (12, "is gone far"), (13, "the red fox"), (13, "the red fox")]
    got = sorted(map(tuple, spotsigs.fingerprint_classes(frame(spark, [*docs, (None, none)])).collect()))
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (4, 4, 0), (5, 4, 0), (6, 6, 0), (11, 11, 0), (12, 12, 0), (13, 3, 1)]
    docs = docs[:-1]
    r = random.Random(3)
    for i in range(200):
        t = " ".join(r.choice(["the", "is", "x", "y", "z", "w", "of"]) for _ in range(r.randint(1, 14)))
        docs += [(100 + 2 * i, t), (101 + 2 * i, t if i % 5 else t + " v")]
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]}))
    want = sorted(db.execute(oracle.fingerprint_classes()).fetchall())
    assert sorted(map(tuple, spotsigs.fingerprint_classes(frame(spark, docs)).collect())) == want


def test_near_groups_recall_and_precision(spark, corpus, monkeypatch):
    sets = {}
    for i, t in corpus:
        if i is not None and t:
            d = np.frombuffer(t.encode(), np.uint8)
            h, doc, first = K.words(d, np.array([0, len(d)]))
            s = set(K.shingles(h, doc, first, near_dedup.SHINGLE)[0].tolist())
            if s:
                sets[i] = s
    near, far = jaccards(sets, 0.65), jaccards(sets, 0.45)
    df = frame(spark, corpus)
    for small, hot in ((128, 50000), (16, 50000), (16, 100)):  # the smaller makes leaders, rims and several levels, and splits nodes
        monkeypatch.setattr(near_dedup, "SMALL", small)
        monkeypatch.setattr(near_dedup, "HOT", hot)
        rows = near_dedup.near_groups(df).collect()
        group = {x.doc_id: x.group_id for x in rows}
        sizes = defaultdict(list)
        for i, g in group.items():
            sizes[g].append(i)
        assert len(group) == len(rows) and all(x.n == len(sizes[x.group_id]) > 1 and min(sizes[x.group_id]) == x.group_id for x in rows)
        hit = sum(group.get(a, -1) == group.get(b, -2) for a, b in near)
        assert hit / len(near) >= 0.98
        links = defaultdict(set)
        for a, b in far:
            links[a].add(b)
            links[b].add(a)
        assert all(links[i] for i in group)
        assert not {5000, 5001, 5002, 5003} & group.keys()
        assert group[5004] == group[5005] == 5004
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns
    assert kept.count() == len(corpus) - len(rows) + len(sizes)
    assert near_dedup.near_groups(frame(spark, [])).collect() == []


def test_paths_use_no_minhash_twice_and_end():
    used, path, seen = 0, 77, []
    while picks := near_dedup.chosen(path, 0.6, used):
        assert len(picks) == len(set(picks)) and not any(used >> p & 1 for p in picks)
        seen += picks
        for p in picks:
            used |= 1 << p
        path = near_dedup._mix(path)
    assert sorted(seen) == list(range(near_dedup.SKETCH))


def test_trees_are_added_until_the_target(spark, corpus, monkeypatch):
    df = frame(spark, corpus[:400])
    asked = []
    real = near_dedup.measured_recall
    monkeypatch.setattr(near_dedup, "measured_recall", lambda *a, **k: (asked.append(real(*a, **k)), (len(asked) / 3, 5))[1])
    near_dedup.near_groups(df, trees=1, target=0.9).collect()
    assert len(asked) == 3 and asked[0][0] <= asked[2][0]
    with pytest.warns(UserWarning, match="2 trees reach a recall"):
        near_dedup.near_groups(df, trees=1, target=9, most_trees=2).collect()


def test_a_large_node_of_one_sketch_ends(spark):
    """Texts whose sketches agree in every byte can't be parted by branching."""
    rows = [(i, "a b " * (2 + i)) for i in range(700)]
    got = {x.doc_id: x.group_id for x in near_dedup.near_groups(frame(spark, rows)).collect()}
    assert got == {i: 0 for i in range(700)}


# --- classifier


def test_probability_is_of_the_whole_text_and_any_batch():
    net = quality_cnn.ByteCNN.fresh(1)
    r = random.Random(2)
    texts = [b"", b"a", b"ab", prose(r, 900).encode(), prose(r, 3).encode(), "é".encode() * 99]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    got = net.probability(data, offs)
    for i, t in enumerate(texts):
        padded = np.frombuffer(t + b"\0" * 16, np.uint8)
        n = max(1, -(-len(t) // quality_cnn.STRIDE))
        top = np.max([np.einsum("we,wef->f", net.emb[padded[k * 2 : k * 2 + 8] if k * 2 + 8 <= len(t) else np.append(padded[k * 2 : len(t)], np.zeros(k * 2 + 8 - len(t), np.uint8))], net.filt) for k in range(n)], 0)
        want = 1 / (1 + np.exp(-(np.maximum(top + net.bias, 0) @ net.w + net.b)))
        assert abs(got[i] - want) < 1e-4
    again = quality_cnn.ByteCNN.load(net.dump())
    assert np.allclose(again.probability(data, offs), got, atol=1e-5)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    net = quality_cnn.train(docs, labels.filter("doc_id % 2 = 0"))
    rows = quality_cnn.score(docs, net, ["doc_id"], name="p").join(labels.filter("doc_id % 2 = 1"), "doc_id").select("p", "quality").collect()
    good = [x.p >= 0.5 for x in rows if x.quality == 1]
    bad = [x.p < 0.5 for x in rows if x.quality == 0]
    assert sum(good) / len(good) > 0.97, sum(good) / len(good)
    assert sum(bad) / len(bad) > 0.9, sum(bad) / len(bad)


def test_classifier_cases(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "some words"), (3, "some words"), (4, "x" * 300000)])
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, None), (5, 0)], "doc_id bigint, quality int")
    net = quality_cnn.train(df, labels)
    got = quality_cnn.score(df, net, df.columns).collect()
    p = {x.doc_id: x.quality for x in got}
    assert len(got) == 5 and p[1] is None and p[2] == 0.0 and 0 < p[3] < 1
    assert quality_cnn.train(df, labels.limit(0)) == 1.0
    assert quality_cnn.train(df, labels.filter("quality = 0")) == 0.0
    assert {x.p for x in quality_cnn.score(df.filter("doc_id = 3"), 1.0, ["doc_id"], name="p").collect()} == {1.0}
    assert quality_cnn.score(df.limit(0), net, ["doc_id"]).collect() == []
    clash = quality_cnn.score(df.withColumn("Quality", F.lit(1)), net, ["doc_id", "Quality", "c0"])
    assert clash.columns == ["doc_id", "c0", "quality"] and {x.doc_id: x.quality for x in clash.collect()} == p
    assert {x.doc_id for x in quality_cnn.keep_good(df, net, 0.0).collect()} == {2, 3, 4} and quality_cnn.keep_good(df, net, 0.0).columns == df.columns


def naive_probability(net, text):
    """Every filter at every second byte of the padded text, one by one."""
    if not text:
        return 0.0
    n = max(1, -(-len(text) // quality_cnn.STRIDE))
    data = np.frombuffer(text + b"\0" * quality_cnn.WIDTH, np.uint8)
    windows = np.stack([data[2 * k : 2 * k + quality_cnn.WIDTH] for k in range(n)])
    top = np.tensordot(net.emb[windows], net.filt, ([1, 2], [0, 1])).max(0)
    return 1 / (1 + np.exp(-(np.maximum(top + net.bias, 0) @ net.w + net.b)))


def test_long_texts_are_pooled_by_segments():
    net = quality_cnn.ByteCNN.fresh(4)
    r = np.random.default_rng(1)
    for n in (1000, 1001, 1006, 1007, 4096, 4097):
        text = r.integers(1, 256, n, np.uint8)
        whole = net.pool(text, np.array([0, n]))[0][0]
        assert np.allclose(net.pool_long(text, segment=500), whole, atol=1e-5)


def test_op8_equals_brute_force(spark):
    from lakeloom.llm import queries

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = quality_cnn.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {x.doc_id: (x.quality, x.keep) for x in queries.op8_quality(spark, d).collect()}
    texts = {x.doc_id: x.text.encode() for x in docs.collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        p = naive_probability(net, t)
        assert abs(got[i][0] - p) < 1e-4 and (got[i][1] == (p >= 0.5) or abs(p - 0.5) < 1e-4)
