"""The training-data operators against brute force, on small tables with nulls, ties, repeats, empty and long texts and clashing column names."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import bpe, common, graph, langid, line_dedup, minhash, nn_descent, packing, sharding, suffix_dedup, tiff, warc
from tessera.llm.graph import components
from tessera.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, slice int, n int, ids string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "an", "re", "ing", "ou", "é", "ß"]) for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join(word() for _ in range(rng.randint(0, 200))) for _ in range(30)]
    texts[3] = texts[2]
    texts[5] = f"{texts[5]} {passage}\n{texts[6][:90]}"
    texts[9] = f"{passage} {texts[9]} {passage}"
    texts += ["", None, "a", "\x1c odd space  \r\n\t<|endoftext|> end", " ".join(word() for _ in range(9000)), "!!! 123", "same same " * 60]
    return list(enumerate(texts)) + [(None, "null id " * 12)]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, "x") for i, t in rows], schema)


def test_substring_dedup(spark, corpus):
    rows = corpus + [(2, corpus[2][1])]
    got = suffix_dedup.remove_repeats(frame(spark, rows), 20, least_groups=8).collect()
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        hit = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                hit[k : k + 20] = [True] * 20
            seen.add(key)
        want.append((i, len(w), sum(hit), b" ".join(x for x, h in zip(w, hit) if not h).decode()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_heavy_prefixes_are_split():
    counts = np.zeros(suffix_dedup.CELLS * suffix_dedup.FINE, np.int64)
    counts[70] = 1000
    counts[64:70] = 3
    first, split, n = suffix_dedup.plan_groups(counts, 100, 1)
    assert split[70] == 10 and first[70] + 10 <= n and (first[64:70] < first[70]).all()


def test_language_id(spark):
    rng = random.Random(1)
    kinds = {"aa": ["tha", "ing", "ou"], "bb": ["zug", "eß", "ver"], "cc": ["ció", "que", "lla"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(rng.randint(3, 40))), k) for i in range(240) for k in [rng.choice(list(kinds))]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (None, "thaing ouing thatha", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    test = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == k for i, _, k in test]) > 0.97 and all(got[i].held_out for i, *_ in test)
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert got[None].lang_pred == "aa" and not got[None].held_out
    assert langid.identify(spark.createDataFrame([(1, "x", None)], "doc_id long, text string, lang string")).first().lang_pred == "und"


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    got = packing.pack(frame(spark, corpus), path, 256, 2, least_ranges=4).collect()
    for i, t in corpus:
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    place = 0
    for s, o, n in sorted((r.sequence_id, r.offset, r.length) for r in got):
        assert (s, o) == divmod(place, 256) and o + n <= 256
        place += n
    assert packing.pack(frame(spark, []), path).count() == 0


def test_hilbert_neighbours_are_adjacent():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    k = packing.hilbert_key(grid, 3)
    assert sorted(k) == list(range(512))
    walk = grid[np.argsort(k)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near(a, b):
    most = min(2, min(len(a), len(b)) // 16)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def test_line_dedup(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(*rng.choice([(36, 60), (10, 36)])))).strip() + "." for _ in range(25)]

    def edit(s, n):
        for _ in range(n):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abxy") + s[i:], s[:i] + "z" + s[i + 1 :]])
        return s

    docs = [(d, "\n".join(rng.choice([lambda: edit(rng.choice(base), rng.randint(0, 4)), lambda: rng.choice(["", " ", "ab"]), lambda: rng.choice(base)])() for _ in range(8))) for d in range(30)]
    docs += [(100, None), (101, ""), (102, "x" * 5000 + "\n" + "x" * 4999 + "y")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, docs), 2, 16).collect()}
    first = []
    for d, t in docs:
        kept = []
        for line in (t.split("\n") if t is not None else []):
            if not line.strip(" "):
                kept.append(line)
            elif line not in first:
                alike = any(near(f, line) for f in first)
                first.append(line)
                if not alike:
                    kept.append(line)
        assert got[d].kept_text == ("\n".join(kept) if t is not None else None), d


def lines_left(rows):
    """(doc_id, text without repeated lines) of rows (doc_id, text) by brute force, null ids first, then by text."""
    first, out = [], []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        kept = []
        for line in t.split("\n") if t is not None else []:
            if not line.strip(" "):
                kept.append(line)
            elif line not in first:
                if not any(near(f, line) for f in first):
                    kept.append(line)
                first.append(line)
        out.append((i, "\n".join(kept) if t is not None else None))
    return out


def test_line_dedup_of_repeated_and_null_ids(spark):
    rng = random.Random(9)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(45)) + "."
    x = [line() for _ in range(12)]
    alike = "z" + x[0][1:]
    rows = [(1, f"{x[0]}\n{x[1]}"), (2, f"{alike}\n{x[2]}"), (2, f"{x[3]}\n{x[4]}"), (None, f"{x[5]}\n{x[6]}"), (None, f"{x[7]}\n{x[8]}"), (None, f"{x[5]}\n{x[9]}"), (3, f"{x[10]}\n{x[1]}"), (3, f"{x[11]}\n{x[1]}"), (4, x[2] + "!"), (4, x[2] + "!"), (5, None), (5, "")]
    got = [(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(frame(spark, rows), 2, 16).collect()]
    assert sorted(got, key=str) == sorted(lines_left(rows), key=str)


def test_line_dedup_of_templates_long_documents_and_clashing_columns(spark):
    rng = random.Random(10)
    lines = [f"Entry {rng.randrange(10**4):04d} of the common template, as it stands." for _ in range(150)]
    rows = [(i, "\n".join(lines[i * 10 : i * 10 + 10])) for i in range(15)] + [(20, "\n".join(f"{i}" for i in range(40_000)))]
    docs = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id long, text string, row_key int, lines int, _lines int")
    out = line_dedup.rewrite_lines(docs, common.free_name(docs, "lines")).collect()
    assert sorted((r.doc_id, r["__lines"].kept_text) for r in out) == sorted(lines_left(rows[:-1])) + [(20, rows[-1][1])]
    assert all((r.row_key, r.lines, r["_lines"]) == (5, 6, 7) for r in out)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_minhash(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(20):
        w = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += ["one two three", "one two three", "one two four", "", "", None]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert len(got) == len(texts)
    shingle = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))((t or "").split())
    s = [shingle(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            jac = len(s[i] & s[j]) / max(1, len(s[i] | s[j]))
            if jac >= 0.82:
                assert got[i].component_id == got[j].component_id
            if jac < 0.5 and s[i] and s[j] and not any(len(s[i] & x) for k, x in enumerate(s) if k != i and len(s[i] & x) / len(s[i] | x) > 0.7):
                assert got[i].component_id != got[j].component_id
    assert all(got[i].kept and got[i].component_id == i for i in range(len(texts) - 3, len(texts)))
    assert sum(r.kept for r in got.values()) == len({r.component_id for r in got.values()})
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_minhash_parities_never_exceed_the_difference():
    rng = np.random.default_rng(11)
    for size in (1, 5, 80, 3000):
        shared, own = rng.integers(0, 2**64, size, dtype=np.uint64), rng.integers(0, 2**64, size // 2 + 1, dtype=np.uint64)
        value = np.concatenate([shared, shared, own])
        of = np.repeat([0, 1, 1, 2], [size, size, len(own), 0])
        x, y, empty = minhash.parities(value, of, 3)
        assert 0 < sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(own)
        assert not empty.any()


def weighted_components(texts, threshold=0.8, spread=minhash.IDF):
    """The least number of the group of each text by exact weighted Jaccard similarity over all pairs; df over distinct texts."""
    from collections import Counter
    from math import log

    def counted(t):
        w = (t or "").split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or Counter([tuple(w)] if w else [])

    s, n = [counted(t) for t in texts], len(texts)
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    df = Counter(x for t, i in first.items() for x in s[i])
    weigh = [{x: k * (1 + spread * log((n + 1) / (min(df[x], n) + 1)) / log(n + 1)) for x, k in c.items()} for c in s]
    group = list(range(n))
    pairs = [(i, j) for i in range(n) for j in range(i) if s[i] and s[j] and (lambda o: o >= threshold * (sum(weigh[i].values()) + sum(weigh[j].values()) - o))(sum(min(w, weigh[j].get(x, 0)) for x, w in weigh[i].items()))]
    for _ in texts:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    return group


def test_minhash_groups_equal_all_pairs(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(4000)]
    passage, texts = [rng.choice(words) for _ in range(70)], []
    for n in [1] * 10 + [3] * 8 + [40]:
        base = [rng.choice(words) for _ in range(rng.randint(80, 160))]
        for _ in range(n):
            v = list(base)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(["x", "y", "z"])
            texts.append(" ".join(v))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.randint(5, 40))]) for _ in range(60)]  # of one passage, some of them near
    texts += [texts[3], texts[30], "", None, "one two", "one two", "one three"]
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    texts.append(texts[-1].replace(" w1 ", " v1 "))
    docs = spark.createDataFrame([(None if i == 0 else i, t, 1, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, slice int, bucket int, keys int")
    got = {r.doc_id or 0: (r.component_id or 0, r.kept) for r in minhash.near_duplicates(docs).collect()}
    want = weighted_components(texts)
    assert got == {i: (g, g == i) for i, g in enumerate(want)}
    assert len(set(want)) < len(texts) - 40


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_few_links_need_no_rounds(spark, monkeypatch):
    """A round deals its rows out several times: of few links it costs as much as of many, and three searches of some rounds each took most of op6's time on 211 partitions."""
    written = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, *a: (written.append(label), write(df, label, *a))[1])
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(80)) for _ in range(12)]
    texts += [f"{t} more" for t in texts[:8]] + [f"other {t}" for t in texts[4:]] + texts[:2]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(weighted_components(texts)))
    assert set(written) == {"edges"} and len(written) <= 3


@pytest.mark.parametrize("most", [0, 10**6])
def test_components_by_rounds_and_by_the_driver(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "DRIVER_LINKS", most)
    written = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label, *a: (written.append(label), write(df, label, *a))[1])
    rng = random.Random(13)
    least, path = common.LEAST_LONG, list(range(5000, 5300))
    rng.shuffle(path)
    edges = [(least, 7), (7, 2**62), (3, 3), *zip(path, path[1:], strict=False), *[(900, i) for i in range(100, 180)], *[(rng.randrange(10**6, 10**6 + 500), rng.randrange(10**6, 10**6 + 500)) for _ in range(300)]] * 2
    want: dict = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in want:
        before = dict(want)
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
    # stars are known as such in the round that makes them
    del written[:]
    star = {r.node: r.component for r in components(spark.createDataFrame([(1, i) for i in range(2, 40)], "a long, b long")).collect()}
    assert star == dict.fromkeys(range(1, 40), 1)
    assert written.count("stars") == (0 if most else 1)


def test_nn_descent(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    x = [(c + rng.normal(scale=0.05, size=16)).tolist() for c in centres for _ in range(rng.integers(1, 40))]
    x += [x[0], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, [1.0, 2.0], []]
    rows = [(i, v, 0) for i, v in enumerate(x)] + [(None, x[1], 0)]
    got = {r.vec_id: r for r in nn_descent.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    n = len(x) - 6
    a = np.array(x[:n], np.float32).astype(float)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.95
    np.fill_diagonal(near, False)
    links = sum(got[i].n_links for i in range(n))
    assert links >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(n))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(n, len(x)))


def test_nn_descent_audit_weighs_queries_not_links(spark):
    rng = np.random.default_rng(1)
    group = np.eye(1, 24)[0] + rng.normal(scale=0.01, size=(80, 24))
    pairs = np.repeat(rng.normal(size=(20, 24)), 2, axis=0) + rng.normal(scale=0.01, size=(40, 24))
    x = np.concatenate([group, pairs])
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, 1, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, copies long, unit binary")
    lost = spark.createDataFrame([(i, 79 if i < 80 else 0, 0 if i < 80 else i) for i in range(120)], "node long, links long, component long")
    assert nn_descent.audit_recall(nodes, lost, 0.95) < nn_descent.LEAST_RECALL
    assert nn_descent.audit_by_size(nodes, lost, 0.95)["more"][1] == 1.0
    found = spark.createDataFrame([(i, 79 if i < 80 else 1, 0 if i < 80 else i - i % 2) for i in range(120)], "node long, links long, component long")
    assert nn_descent.audit_recall(nodes, found, 0.95) == 1.0


def test_nn_descent_compares_all_where_too_few_links_are_found(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.repeat(rng.normal(size=(60, 12)), 2, axis=0), np.repeat(rng.normal(size=(2, 12)), 30, axis=0)])
    x = x + rng.normal(scale=0.1, size=x.shape)
    x = np.concatenate([x, x[:3]])
    for name, value in (("CELL", 2), ("BLOCK", 4), ("MOST_ROUNDS", 1), ("MOST_TREES", 1), ("EXACT_BLOCK", 40), ("EXACT_ROWS", 16)):
        monkeypatch.setattr(nn_descent, name, value, raising=False)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in nn_descent.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2, trees=1).collect()}
    a = np.array(x, np.float32).astype(float)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.95
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    for _ in least:
        least = np.minimum(least, np.where(near, least[None, :], len(x)).min(axis=1))
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(near[i].sum()), int(least[i]), bool(least[i] == i)) for i in range(len(x))]


def test_nn_descent_trees_grow_with_the_cells():
    for bits in (6, 12, 16):
        same = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - same) ** nn_descent.trees_for(bits, 0.95) >= 0.99


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(5)
    pages = [rng.integers(0, 256, (50, 70), np.uint8), np.zeros((300, 64), np.uint8), (np.arange(90 * 64) // 7 % 256).reshape(90, 64).astype(np.uint8), rng.integers(0, 256, (200, 64), np.uint8)]
    for big in (False, True):
        back = list(tiff.decode(tiff.encode(pages, compression, predictor, 33, tile, big)))
        assert len(back) == 4 and all((p == q).all() for p, q in zip(pages, back))


def test_tiff_rows_and_damage(spark, corpus):
    docs = frame(spark, corpus)
    for r in tiff.digests(docs).collect():
        raw = (dict(corpus)[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    two = tiff.encode([np.ones((4, 4), np.uint8), np.zeros((2, 4), np.uint8)])
    rows = tiff.read_pages(spark.createDataFrame([(1, two), (2, b"II*\0junk"), (3, None), (4, two[:-30])], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.page) for r in rows if r.doc_id < 4] == [(1, 0), (1, 1), (2, -1)] and any(r.error for r in rows if r.doc_id == 4)


def test_bpe(spark, corpus):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    rng = random.Random(6)
    odd = ["".join(rng.choice("abc '\n\t\r  　\x85\x1f0123é漢字😀!?.s<|endoftext|>lL") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    odd += ["<|endoftext|>", "a<|endoftext|>  b<|endoftext|><|endoftext|>", "it's we'll  x 's\n\n y", "xxxxxxxxxxx aaaaaaaaaaaaaaaa zzzz   ", "\n", " ", "  \n x"]
    rows = corpus + [(1000 + i, t) for i, t in enumerate(odd)]
    for r in bpe.digests(frame(spark, rows), path).collect():
        ids = tok.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), repr(dict(rows)[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, corpus), path), path).collect()}
    assert back == {i: t or "" for i, t in corpus}


def segments(words):
    return np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


@pytest.mark.parametrize("most", [5, 60, 10_000])
@pytest.mark.parametrize("bits", [64, 5])
def test_id_cache_finds_what_was_encoded(most, bits, monkeypatch):
    real = common.segment_hashes
    monkeypatch.setattr(common, "segment_hashes", lambda *a: real(*a) >> np.uint64(64 - bits))  # with 5 bits most words collide
    rng, cache = np.random.default_rng(7), common.IdCache(most)
    ids_of = lambda w: [len(w) * 7 + w[0] + i for i in range(w[0] % 4)]
    for _ in range(30):
        words = sorted({b"%d" % x * (x % 3 + 1) for x in rng.integers(0, 300, rng.integers(0, 50))})
        at, n = cache.find(*segments(words), lambda places, words=words: [ids_of(words[i]) for i in places])
        assert [cache.flat[a : a + k].tolist() for a, k in zip(at, n, strict=True)] == [ids_of(w) for w in words]
        assert len(cache) <= max(most, 50)  # no piece has more words


def thue_morse(n):
    word, other = "a", "b"
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("n", [1024, 8192])
def test_words_that_differ_have_different_hashes_and_ids(spark, n):
    from tokenizers import Tokenizer

    pair = thue_morse(n)
    assert len(set(common.segment_hashes(*(lambda d, o: (d, o[:-1], np.diff(o)))(*segments([w.encode() for w in pair]))).tolist())) == 2
    for name, load in (("word_bpe_49k.json", packing.load), ("byte_bpe_50k.json", bpe.load)):
        tok = Tokenizer.from_file(vocabulary(name))
        tok.no_padding()
        tok.no_truncation()
        ids, at = load(vocabulary(name)).encode_bytes(*segments([w.encode() for w in pair]))
        assert [ids[a:z].tolist() for a, z in zip(at[:-1], at[1:])] == [tok.encode(w, add_special_tokens=False).ids for w in pair]
    common_words = " ".join(f"w{i}" for i in range(19))
    rows = spark.createDataFrame([(i, f"{common_words} {w}") for i, w in enumerate(pair)], "doc_id long, text string")
    assert {r.n_removed for r in suffix_dedup.remove_repeats(rows, 20, least_groups=2).collect()} == {0}
    data, offsets = segments([f"{w} x y z {w}".encode() for w in pair])
    of, value, _, _ = minhash.shingles(data, offsets, 5)
    assert len(set(value.tolist())) == 2


def test_sharding(spark, corpus):
    rows = corpus + [(i, "x") for i in range(200, 3000)] + [(7, "again"), (7, "again")]
    got = sharding.shard(frame(spark, rows), (1.0,) * 9 + (3.0,)).collect()
    assert len(got) == len(rows)
    for s in range(10):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 10) for r in got) and len({r.shard for r in got if r.doc_id == 7}) == 1
    share = np.bincount([r.shard for r in got], minlength=10) / len(got)
    assert abs(share[9] - 0.25) < 0.04 and abs(share[0] - 1 / 12) < 0.03
    assert sharding.shard(frame(spark, [])).count() == 0


def test_warc(spark):
    big = "é" * 700
    rows = [(1, "http://a/\r\nx", big, 0), (2, None, big, 0), (3, "u", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (None, "u", big, 0), (2, None, big, 0)]
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect()), key=str)
    sha = lambda s: hashlib.sha1(s.encode()).hexdigest()
    want = [(1, 1400, sha(big), "revisit", 2), (2, 1400, sha(big), "response", None), (2, 1400, sha(big), "response", None), (3, 5, sha("small"), "response", None), (4, 5, sha("small"), "response", None), (5, 0, sha(""), "response", None), (0, 1400, sha(big), "revisit", 2)]
    assert got == sorted(want, key=str)


def test_warc_salvage():
    records = [warc.record(i, "u", f"payload {i} WARC/1.1\r\n".encode() * 20, hashlib.sha1(f"payload {i} WARC/1.1\r\n".encode() * 20).hexdigest()) for i in range(6)]
    for pack in (warc.member, bytes):
        parts = [pack(r) for r in records]
        data = b"".join(parts)
        assert [r[0]["warc-record-id"] for r in warc.salvage(data)[0]] == [f"<urn:page:{i}>" for i in range(6)] and warc.salvage(data)[1] == []
        at = sum(map(len, parts[:2]))
        for hurt in (data[: at + 40] + b"\xff\x00" * 30 + data[at + 100 :], data[: at + 30] + data[at + len(parts[2]) :], data[:at] + b"garbage WARC/ \x1f\x8b" + data[at + len(parts[2]) :]):
            found, gaps = warc.salvage(hurt)
            assert [r[0]["warc-record-id"] for r in found] == [f"<urn:page:{i}>" for i in (0, 1, 3, 4, 5)]
            assert len(gaps) == 1 and gaps[0][0] == at and hurt[gaps[0][1] :] == data[at + len(parts[2]) :]
        found, gaps = warc.salvage(data[:-7])
        assert len(found) == (6 if pack is warc.member else 5) and gaps == [(sum(map(len, parts[:5])), len(data) - 7)]


def test_warc_salvage_inside_members(spark):
    payload = lambda i: f"payload {i} of a page ".encode() * 30
    records = [warc.record(i, "u", payload(i), hashlib.sha1(payload(i)).hexdigest()) for i in range(9)]
    ids = lambda data: [int(r[0]["warc-record-id"][10:-1]) for r in warc.salvage(data)[0]]
    bad = records[1][:-50] + b"#" + records[1][-49:]
    first, second, third = warc.member(records[0] + bad + records[2]), warc.member(records[3]), warc.member(b"".join(records[4:8]))
    assert ids(first + second) == [0, 2, 3] and warc.salvage(first + second)[1] == [(0, len(first))]
    cut = third[: len(third) * 3 // 4]
    assert ids(second + cut) in ([3, 4], [3, 4, 5], [3, 4, 5, 6]) and warc.salvage(second + cut)[1] == [(len(second), len(second + cut))]
    hurt = third[: len(third) - 8] + b"abcd" + third[-4:]  # the checksum is wrong
    assert ids(hurt + second) == [4, 5, 6, 7, 3] and warc.salvage(hurt + second)[1] == [(0, len(hurt))]
    rows = warc.read_archives(spark.createDataFrame([(first + b"junk" + second,), (None,), (b"",), (b"junk",)], "content binary")).collect()
    assert sorted(r.page_id for r in rows if r.page_id is not None) == [0, 2, 3]
    assert sorted((r.gap_start, r.gap_end) for r in rows if r.page_id is None) == [(0, 4), (0, len(first)), (len(first), len(first) + 4)]
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tiff_rejects_malformed_pages(spark):
    import struct

    good = tiff.encode([np.arange(64, dtype=np.uint8).reshape(8, 8)], predictor=1)
    (at,) = struct.unpack_from("<I", good, 4)
    tags = {struct.unpack_from("<H", good, at + 2 + 12 * i)[0]: at + 10 + 12 * i for i in range(struct.unpack_from("<H", good, at)[0])}
    files = []
    for tag, value in ((tiff.WIDTH, 0), (tiff.HEIGHT, 0), (tiff.WIDTH, 4_000_000), (tiff.HEIGHT, 4_000_000), (tiff.ROWS_PER_STRIP, 0), (tiff.STRIP_OFFSETS, 1 << 31), (tiff.STRIP_BYTES, 1 << 31), (tiff.COMPRESSION, 77), (tiff.PREDICTOR, 9)):
        data = bytearray(good)
        struct.pack_into("<I", data, tags[tag], value)
        files.append(bytes(data))
    rng = random.Random(1)
    for _ in range(200):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        files.append(bytes(data[: rng.randint(1, len(data))]))
    rows = tiff.read_pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary")).collect()
    assert all(r.page == -1 and r.error for r in rows if r.doc_id < 9) and {r.doc_id for r in rows} >= set(range(9))
    long = "é" * (tiff.WIDE * tiff.PAGE_ROWS)
    docs = spark.createDataFrame([(1, long, 0)], "doc_id long, text string, media int")
    assert [(r.page, r.height) for r in tiff.read_pages(tiff.encode_texts(docs)).collect()] == [(0, 1024), (1, 1024)]
    assert tiff.digests(docs).first().payload_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert tiff.digests(docs.limit(0)).count() == 0


def test_language_of_long_texts_equals_plain_sums(monkeypatch):
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)), rng.normal(size=3), 0.7, 0.2)

    def plain(text):
        total, n = np.zeros(3), 0
        for word in bytes(langid._NORMAL[np.frombuffer(text.encode(), np.uint8)]).split(b" "):
            for k in langid.GRAMS if word else ():
                padded = b" " + word + b" "
                for i in range(len(padded) - k + 1):
                    h = k
                    for c in padded[i : i + k]:
                        h = (h ^ c) * 0x100000001B3 % 2**64
                    total += model.scores[(((h ^ (h >> 29)) * 0x9E3779B97F4A7C15 % 2**64) >> 48) % langid.BUCKETS]
                    n += 1
        return langid.softmax(((total / n + model.bias) / model.temperature)[None])[0]

    texts = ["ein Wort", "a b", "Größe, und 12 more!", " ".join(f"w{'xyz'[i % 3] * (i % 7)}" for i in range(400)), "one " * 90]
    for most in (1 << 20, 64):
        monkeypatch.setattr(langid, "PART_BYTES", most)
        got = model.predict(*segments([t.encode() for t in texts]))
        assert np.allclose(got, [plain(t) for t in texts], atol=1e-9)


def test_empty_tables_repeated_rows_and_clashing_columns(spark):
    clash = "doc_id long, text string, lang string, held_out int, accepted int, ids int, media int, shard int, k int, b int, r int"
    row = (1, "la la la ou ing", "aa", 1, 2, 3, 4, 5, 6, 7, 8)
    docs = spark.createDataFrame([row, row, (None, None, None, *row[3:])], clash)
    for d, n in ((docs, 3), (docs.limit(0), 0)):
        assert langid.identify(d).count() == n
        assert len(langid.accepted_rows(d).columns) == 11
        assert bpe.digests(d, vocabulary("byte_bpe_50k.json")).count() == n
        assert packing.pack(d, vocabulary("word_bpe_49k.json"), least_ranges=2).count() == n
        assert tiff.digests(d).count() == n
        assert sorted(r.slot for r in sharding.shard(d, (1.0,)).collect()) == list(range(n))
        assert suffix_dedup.remove_repeats(d, least_groups=2).count() == n
        back = suffix_dedup.rewrite_repeats(d, least_groups=2)
        assert back.columns == [*d.columns, "n_removed"] and back.count() == n


def test_empty_embeddings_and_repeated_keys(spark):
    schema = "vec_id long, embedding array<float>, node int, links int"
    assert nn_descent.link_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.01], 1, 1), (None, [1.0, 0.0], 1, 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in nn_descent.link_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]


def test_pipeline_shape():
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "minhash_dedup", "substring_dedup", "packing"]


@pytest.fixture(scope="module")
def odd_documents():
    """(doc_id, text, lang, source) with null and repeated ids, equal rows, near copies, shared lines and passages, empty, null and long texts; source numbers the rows."""
    rng = random.Random(12)
    kinds = {"aa": ["tha", "ing", "ou"], "bb": ["zug", "eß", "ver"]}
    word = lambda k: "".join(rng.choice(kinds[k]) for _ in range(rng.randint(3, 6)))
    text = lambda k, n: "\n".join(" ".join(word(k) for _ in range(12)) for _ in range(n))
    rows = [(i, text(k, rng.randint(2, 5)), k) for i in range(20) for k in [rng.choice(["aa", "bb"])]]
    copy = rows[3][1].split(" ")
    rows += [(30, " ".join(copy), "aa"), (31, " ".join(copy[:-1] + ["last"]), "aa")]  # an equal text, a near copy
    rows += [(32, text("aa", 2) + "\n" + rows[4][1].split("\n")[1], None), (33, text("bb", 1) + " " + " ".join(rows[5][1].split()[:23]), "bb")]
    same = text("aa", 4)
    rows += [(7, text("aa", 3), "aa"), (7, "12 !?", "aa"), (8, text("bb", 3), "bb"), (40, same, "aa"), (40, same, "aa")]
    rows += [(None, text("aa", 3), None), (None, text("bb", 2), None), (None, "?? 12", None), (None, rows[6][1], None), (None, text("aa", 2), None)]
    rows += [(41, "", None), (42, None, None), (42, None, None), (43, text("aa", 60), "aa")]
    return [(i, t, k, str(n)) for n, (i, t, k) in enumerate(rows)]


def pipeline_frame(spark, rows):
    return spark.createDataFrame([(i, t, k, s, len(t or "")) for i, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def by_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def languages_left(spark, rows):
    model = langid.train(pipeline_frame(spark, rows))
    one = spark.createDataFrame([(n, r[1]) for n, r in enumerate(rows)], "doc_id long, text string")
    good = {r.doc_id for r in langid.identify(one, model).collect() if r.accepted}
    return [(r[0], r[1]) for n, r in enumerate(rows) if n in good]


def documents_left(rows):
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))((t or "").split())
    out, seen = [], []
    for r in by_order(rows):
        s = shingles(r[1])
        if not any(s and len(s & x) / len(s | x) >= 0.8 for x in seen):
            out.append(r)
        seen.append(s)
    return out


def passages_left(rows):
    out, seen = [], set()
    for i, t in by_order(rows):
        w = (t or "").split()
        hit = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                hit[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        out.append((i, " ".join(x for x, h in zip(w, hit) if not h) if any(hit) else t))
    return out


def pairs(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_pipeline_stages_lose_only_what_they_find(spark, odd_documents):
    import corpus_pipeline as p

    docs, rows = pipeline_frame(spark, odd_documents), [r[:2] for r in odd_documents]
    assert pairs(p.identify_language(spark, docs, "")) == sorted(languages_left(spark, odd_documents), key=str)
    lines = p.dedup_lines(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in lines), key=str) == sorted(lines_left(rows), key=str)
    assert sorted(r.source for r in lines) == sorted(r[3] for r in odd_documents) and all(r.n_chars == len(r.text or "") for r in lines)
    assert pairs(p.dedup_documents(spark, docs, "")) == sorted(documents_left(rows), key=str)


def test_pipeline_passages_of_equal_rows_and_null_ids(spark, odd_documents):
    import corpus_pipeline as p

    got = p.dedup_passages(spark, pipeline_frame(spark, odd_documents), "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(passages_left([r[:2] for r in odd_documents]), key=str)
    assert sorted(r.source for r in got) == sorted(r[3] for r in odd_documents) and all(r.n_chars == len(r.text or "") for r in got)


def test_pipeline_run(spark, odd_documents, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    pipeline_frame(spark, odd_documents).write.parquet(str(tmp_path / "documents.parquet"))
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tok.no_padding()
    tok.no_truncation()
    want = passages_left(documents_left(lines_left(languages_left(spark, odd_documents))))
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.doc_tokens) for r in got if r.start == 0), key=str) == sorted(((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in want), key=str)
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
