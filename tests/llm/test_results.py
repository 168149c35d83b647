"""Results against brute force, the public tokenizer, or DuckDB SQL."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from logspark.llm import bpe, jaccard, lattice, lines, lm, near, pii, quality, queries, topk, urls
from logspark.plans.verify import _canon, duck_connection

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(sc, name):
    cur = duck_connection(SF).execute(queries.oracle_sql()[name])
    want = _canon([d[0] for d in cur.description], cur.fetchall())
    got = queries.queries()[name](sc, SF)
    assert _canon(got.columns, [tuple(r) for r in got.collect()]) == want


def test_all_registered():
    import __spark_entry__ as entry

    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in entry.queries()) == 1 for n in names)
    assert "pipeline" in entry.queries()


# --- op1

def test_quality_separates_labels(sc):
    read = sc.read.parquet
    got = quality.resample(read(f"{SF}/documents.parquet"), read(f"{SF}/labels.parquet"))
    both = got.join(read(f"{SF}/labels.parquet"), "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in both)
    assert right >= 0.96 * len(both)
    assert sum(not r.kept for r in both if r.quality) <= 0.03 * len(both)


def test_held_out_labels(sc):
    """Fitted on even ids' labels alone, it still tells the odd ones apart."""
    read = sc.read.parquet
    labels = read("/root/testdata/sf0.1/labels.parquet")
    got = quality.resample(read("/root/testdata/sf0.1/documents.parquet"), labels.filter("doc_id % 2 = 0"))
    odd = got.join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert sum(r.kept == bool(r.quality) for r in odd) >= 0.99 * len(odd)


# --- op2

P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
     "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for n, (kind, pattern) in enumerate(P.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                  "card": lambda: 14 <= len(d) <= 19 and _luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), n, m.end()))
    return ",".join(f"{list(P)[n]}:{a}:{b}" for a, n, b in sorted(out))


def test_pii_base(sc, docs_of):
    rng = random.Random(5)
    bits = ["a@b.c", "x", ".", "@", "1", "22", "255", "256", "007", "+", "-", " ", "(", ")", "_d@e.f", "4111 1111 1111 1111", "+1 (375) 555-4393",
            "é", "😀", "\n", "0.0.0.0", "1.2.3.4.5.6.7.8", "79927398713", "4111111111111111", "+123 456 7890", "%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))) for i in range(3000)]
    rows += [(4000, "+1" + "(" * 5000 + "2"), (4001, "a." * 20000 + "@" + "b." * 20000 + "c"), (4002, "1.2.3.4 " * 3000)]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(rows)).collect()}
    import hashlib
    for i, t in rows:
        assert got[i].base_sha256 == hashlib.sha256(_base(t).encode()).hexdigest(), t[:200]
        assert set(filter(None, _base(t).split(","))) <= set(got[i].spans.split(","))


def test_pii_discovers_from_context(docs_of):
    rows = [(i, f"some words w{chr(97 + i)} mailto: person{i}@mail{i}.example.com over here") for i in range(12)]
    rows += [(50, "see mailto: person77(at)example-host over there"), (51, "the number 123456789 of nothing known"),
             (52, "address=10.0.0.9 x"), (53, "then mailto: 12 over")]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(rows)).collect()}
    assert got[50].spans == "email:12:36" and got[50].n_email == 0 and got[50].n_added == 1
    assert got[51].n_added == 0 and got[53].n_added == 0  # too short to be one
    assert got[52].spans == "ip:8:16"


def test_pii_context_is_the_text_beside(docs_of):
    """Identifiers without digits are added, and a word beside with a digit is context too."""
    rows = [(i, f"some words w{chr(97 + i)} id7: person{i}@mail{i}.example.com x9 here") for i in range(12)]
    rows += [(50, "see id7: jane@intranet x9 there"), (51, "see jane@elsewhere z there")]
    got = {r.doc_id: r for r in pii.personal_data(docs_of(rows)).collect()}
    assert got[50].spans == "email:9:22" and got[50].n_added == 1
    assert got[51].n_added == 0
    cases = pii.instances(pii.matches(docs_of([(1, "a x1 y2 b")]).selectExpr("doc_id", "1 as h", "text"))).collect()
    assert {r.value: r.patterns for r in cases} == {"x1": ["l a", "r y9", "b a y9"], "y2": ["l x9", "r b", "b x9 b"]}


# --- op3

def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def _edited(rng, text, n, letters):
    s = list(text)
    for _ in range(n):
        i, how = rng.randint(0, len(s)), rng.randint(0, 2)
        if how == 0:
            s.insert(i, rng.choice(letters))
        elif i < len(s):
            s[i:i + 1] = [] if how == 1 else [rng.choice(letters)]
    return "".join(s)


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(20_000):
        k = rng.randint(1, 3)
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = _edited(rng, a, rng.randint(0, k + 2), "abc")
        assert lines.within(a, b, k) == (_distance(a, b) <= k), (a, b, k)


def test_segments_miss_nothing():
    rng = random.Random(2)
    plans = {k: lines._Plans(k) for k in (1, 2, 3)}
    for _ in range(10_000):
        k = rng.randint(1, 3)
        a = "".join(rng.choice("abcd") for _ in range(rng.randint(8, 40)))
        b = _edited(rng, a, rng.randint(0, k), "abcd")
        if min(len(a), len(b)) > k and _distance(a, b) <= k:
            assert set(lines.line_keys(a, plans[k])) & set(lines.line_keys(b, plans[k]))


def test_lines_against_brute_force(docs_of):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60))) for _ in range(60)]
    rows = []
    for i in range(150):
        own = [_edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5]), "abcdefgh ") for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(own + [""] * rng.randint(0, 1))))
    place = [(i, no, line) for i, t in rows for no, line in enumerate(t.split("\n")) if line.strip()]
    root = list(range(len(place)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, _, a) in enumerate(place):
        for y in range(x):
            b = place[y][2]
            if a == b or (min(len(a), len(b)) >= lines.SHORT and abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2):
                u, v = top(x), top(y)
                root[max(u, v)] = min(u, v)
    want = {(i, no) for x, (i, no, _) in enumerate(place) if top(x) != x}
    got = {(r.doc_id, no) for r in lines.line_report(docs_of(rows)).collect() for no in r.dropped}
    assert got == want and len(want) > 50


# --- links of dense and loose groups

def test_both_ways_of_checking_agree(sc, monkeypatch):
    """Small blocks make large components; whole blocks and pairs find the same."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((12, 16))
    x = np.concatenate([c + 0.12 * rng.standard_normal((30, 16)) for c in centre])
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    df = sc.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    e = np.array([r[1] for r in rows], np.float32).astype(float)
    e /= np.linalg.norm(e, axis=1)[:, None]
    link = (e @ e.T >= lattice.COSINE) & (np.arange(len(e))[:, None] % 2 == np.arange(len(e))[None, :] % 2)
    np.fill_diagonal(link, False)
    for block in (4, 256):
        monkeypatch.setattr(near, "BLOCK", block)
        got = {r.vec_id: r.n_links for r in lattice.near_vectors(df, tables=16, probes=2).collect()}
        assert [got[i] for i in range(len(e))] == link.sum(axis=1).tolist()


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((500, 8)) * 3
    point = lattice.nearest_e8(x) / 2
    whole = np.all(point == np.rint(point), axis=1)
    assert np.all(whole | np.all(point - 0.5 == np.rint(point - 0.5), axis=1)) and np.all(point.sum(axis=1) % 2 == 0)
    own = ((x - point) ** 2).sum(axis=1)
    for v in lattice.NEIGHBOURS / 2:  # the cell's walls are those to its 240 neighbours
        assert np.all(own <= ((x - point - v) ** 2).sum(axis=1) + 1e-9)
    assert len(lattice.NEIGHBOURS) == 240


def test_lattice_recall():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    label = np.zeros(3000, int)
    ka = lattice.cell_keys(a, label)
    kb = lattice.cell_keys(0.93 * a + math.sqrt(1 - 0.93 ** 2) * b, label)
    assert (ka[:, :, None] == kb[:, None, :]).any(axis=(1, 2)).mean() >= 0.98


# --- op5

def test_cascade_is_exact_over_its_universe(sc):
    keys = sc.range(20_000).selectExpr("cast(id as string) as host", "id % 37 = 0 as listed")
    u = urls.hashed(keys, "host").select("a", "b", "listed").cache()
    levels = urls.build_cascade(u, leak=0.3)
    assert len(levels) > 2
    rows = u.collect()
    a, b = (np.array([r[i] for r in rows]) for i in (0, 1))
    assert urls.listed_by(levels, a, b).tolist() == [r[2] for r in rows]
    one = urls.judge(sc.read.parquet(f"{SMALL}/pages.parquet")).collect()
    many = urls.judge(sc.read.parquet(f"{SMALL}/pages.parquet"), shard_keys=5).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


# --- op6

def test_bpe_is_the_tokenizers_own():
    t = Tokenizer.from_file(bpe.tokenizer_path())
    mine = bpe.Encoder(bpe.read_vocabulary(bpe.tokenizer_path()))
    rng = random.Random(7)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endo<|endoftext|>", "aaaa" * 100, " " * 300, "it's we'll I'd 'S", "\r\n\t \n x", "ÃÂ" * 60]
    letters = [chr(c) for c in [*range(0x250), 0x300, 0x3000, 0x2028, 0x200b, 0xfeff, 0x660, 0x2160, 0x4e2d, 0x1f600]]
    texts += ["".join(rng.choice(letters) if rng.random() < 0.7 else rng.choice(" the'sa") for _ in range(rng.randint(1, 40))) for _ in range(5000)]
    for text, want, got in zip(texts, t.encode_batch(texts, add_special_tokens=False), mine.encode(texts)):
        assert got.tolist() == want.ids, text
        assert mine.decode(got) == t.decode(want.ids, skip_special_tokens=False)


def test_decode_is_its_own_step_too(docs_of):
    rows = [(1, "a word"), (2, None), (3, "\u00e9t\u00e9 \U0001f600")]
    got = bpe.decode(bpe.encode(docs_of(rows), bpe.tokenizer_path()), bpe.tokenizer_path()).collect()
    assert {r.doc_id: r.text for r in got} == {i: t or "" for i, t in rows}


def test_prefixes_are_encoded_once():
    coder = bpe.Encoder(bpe.read_vocabulary(bpe.tokenizer_path()))
    words = {w: w.encode() for w in ("walk", "walked", "walker", "walkers", "wall")}
    alone = {w: coder.learn({w: b})[w] for w, b in words.items()}
    assert coder.learn(words) == alone


# --- op7

def test_topk_over_many_shards(sc):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.integers(-3, 4, (600, 6)) / 64)]  # many ties
    df = sc.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.array([[math.floor(64 * np.float64(np.float32(x))) for x in r] for _, r in rows])
    want = []
    for q in range(0, 600, 20):
        s = v @ v[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-s[i], i))[:20]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    for shard, block in ((40, 7), (4096, 256)):
        got = topk.top_k(df, shard=shard, block=block).collect()
        assert sorted(map(tuple, got)) == want


def test_wide_scores():
    tree = topk.build_tree(np.arange(300), np.random.default_rng(9).integers(-(1 << 28), 1 << 28, (300, 16)))
    q = tree["points"][:1].astype(np.int64)
    row, ids, score = topk.search(tree, np.array([-1]), q, np.array([-(1 << 62)]), 3)
    exact = sorted(((sum(int(a) * int(b) for a, b in zip(q[0], p)), -int(i)) for i, p in zip(tree["ids"], tree["points"])), reverse=True)
    assert [(s, -i) for s, i in zip(score.tolist(), ids.tolist())] == [(s, i) for s, i in exact[:3]]


# --- op9

def test_banding_reaches_its_recall():
    bands, rows = jaccard.banding(0.8, 0.999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def test_near_copies_are_found_and_others_left(docs_of):
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, group = [], {}
    for g in range(40):
        words = [rng.choice(vocabulary) for _ in range(200)]
        for c in range(rng.choice([1, 2, 5, 30])):
            own = list(words)
            for _ in range(c % 3):
                own[rng.randrange(200)] = rng.choice(vocabulary)
            i = len(rows)
            rows.append((i, " ".join(own)))
            group[i] = g
    sets = {i: frozenset(tuple(t.split()[k:k + 5]) for k in range(196)) for i, t in rows}
    n = {i: sum(j != i and group[i] == group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets) for i in sets}
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs_of(rows)).collect()}
    assert {i: r.n_links for i, r in got.items()} == n
    assert all(group[r.class_id] == group[i] for i, r in got.items())


# --- op10

def test_lm_base_and_folds(sc):
    docs = sc.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in rows}
    c = collections.Counter(w for i, words in rows.items() if not held[i] for w in words + [b""])
    total, distinct = sum(c.values()), len(c)
    for top in (1 << 17, 50):  # with few broadcast words the rest comes by join
        got = {r.doc_id: r for r in lm.score(docs, top=top).collect()}
        assert got.keys() == rows.keys()
        for i, words in rows.items():
            want = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words + [b""])
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words) + 1, sum(c[w] > 0 for w in words + [b""]), total)
            assert r.base_score == pytest.approx(want, rel=1e-9)


def _streams(rng, sizes):
    return [np.append(rng.integers(0, lm.END, n), lm.END) for n in sizes]


def _parameters(rng):
    """First parameters and tables of counts, in doubles."""
    x, y, _ = lm.windows(_streams(rng, [300]))
    pairs, kinds = lm.table_counts(x, y)
    held = lm.tables(np.bincount(pairs, minlength=lm.PAD ** 2), np.bincount(kinds, minlength=lm.SLOTS * lm.CLASSES))
    return {k: v.astype(np.float64) for k, v in (lm.first_parameters() | held).items()}


def test_lm_counts_of_ids(sc):
    """Counts of pairs, and of classes by two ids, against dictionaries over whole texts."""
    docs = sc.read.parquet(f"{SMALL}/documents.parquet").selectExpr("coalesce(text, '') AS text")
    path = bpe.tokenizer_path()
    vocabulary = bpe.read_vocabulary(path)
    coder = lm.Subwords(vocabulary).coder
    pairs, kinds = lm.id_counts(docs, sc.sparkContext.broadcast(vocabulary), path)
    want, by_two = collections.Counter(), collections.Counter()
    for r in docs.collect():
        ids = [lm.PAD, lm.END] + coder.encode_ordinary("".join(" " + w.decode() for w in r.text.encode().lower().split())) + [lm.END]
        for a, b, c in zip(ids, ids[1:], ids[2:]):
            want[b * lm.PAD + c] += 1
            by_two[(a * (lm.PAD + 1) + b) % lm.SLOTS * lm.CLASSES + c // lm.MEMBERS] += 1
    for got, expected in ((pairs, want), (kinds, by_two)):
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == expected


def _one_by_one(p, ids):
    """Sum of the natural log probabilities of a text's ids, id after id, without batches."""
    seen, total, ahead = [lm.END] + list(ids[:-1]), 0.0, lm.WINDOW - lm.STRIDE
    for i, wanted in enumerate(ids):
        start = i // lm.STRIDE * lm.STRIDE - ahead  # of the window that scores place i
        places = range(max(0, start), i + 1)
        x = np.array([p["ids"][seen[j]] + p["places"][j - start] for j in places])
        a = np.exp((x[-1] @ p["q"]) @ (x @ p["k"]).T / math.sqrt(lm.WIDTH))
        h = x[-1] + (a / a.sum()) @ (x @ p["v"]) @ p["o"]
        y = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
        before, kind = seen[i - 1] if i else lm.PAD, wanted // lm.MEMBERS
        kinds = y @ p["c"] + p["cb"] + p["by_class"][(before * (lm.PAD + 1) + seen[i]) % lm.SLOTS]
        members = y @ p["m"][kind] + p["mb"][kind] + p["by_member"][kind, seen[i]]
        total += kinds[kind] - np.log(np.exp(kinds).sum()) + members[wanted % lm.MEMBERS] - np.log(np.exp(members).sum())
    return total


def test_lm_score_one_id_at_a_time(sc, monkeypatch):
    """The query's score of some documents against the model run id after id."""
    docs = sc.read.parquet(f"{SMALL}/documents.parquet")
    kept, train = [], lm.train

    def keep(*args):
        kept.append(train(*args))
        return kept[0]

    monkeypatch.setattr(lm, "train", keep)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    p = {k: v.astype(np.float64) for k, v in kept[0].items()}
    coder = lm.Subwords(bpe.read_vocabulary(bpe.tokenizer_path())).coder
    some = sorted(docs.collect(), key=lambda r: len(r.text or ""))
    for r in some[:5] + some[len(some) // 2:][:5]:
        words = (r.text or "").encode().lower().split()
        ids = coder.encode_ordinary("".join(" " + w.decode() for w in words)) + [lm.END]
        assert got[r.doc_id] == pytest.approx(_one_by_one(p, ids) / math.log(10), rel=1e-3)


def test_lm_windows_score_each_id_once():
    rng = np.random.default_rng(11)
    streams = _streams(rng, [0, 1, lm.STRIDE - 1, lm.STRIDE, 3 * lm.STRIDE + 2])
    x, y, owner = lm.windows(streams)
    for i, s in enumerate(streams):
        assert y[owner == i][y[owner == i] != lm.PAD].tolist() == s.tolist()
        assert x[owner == i][0, lm.WINDOW - lm.STRIDE] == lm.END


def test_lm_is_a_distribution_and_causal():
    rng = np.random.default_rng(12)
    p = _parameters(rng)
    x, y, _ = lm.windows(_streams(rng, [60]))
    places = np.arange(lm.STRIDE)
    total = np.zeros(lm.STRIDE)
    for token in range(lm.CLASSES * lm.MEMBERS):
        total += np.exp(lm.log_probability(p, x[:1], np.full((1, lm.STRIDE), token)))[0]
    assert np.allclose(total, 1)
    later = x.copy()
    later[0, lm.WINDOW - lm.STRIDE + 10:] = 3
    a, b = lm.log_probability(p, x, y)[0], lm.log_probability(p, later, y)[0]
    assert np.allclose(a[places < 10], b[places < 10]) and not np.allclose(a[places >= 10], b[places >= 10])


def test_lm_gradients():
    rng = np.random.default_rng(13)
    p = _parameters(rng)
    streams = _streams(rng, [0, 5, 70])
    x, y, _ = lm.windows(streams)
    n = sum(map(len, streams))
    loss, g = lm.gradients(p, x, y)
    assert loss == pytest.approx(-lm.log_probability(p, x, y).sum() / n)
    assert g.keys() == lm.first_parameters().keys()
    for name in g:
        at = tuple(rng.integers(0, k) for k in p[name].shape)
        if name == "ids":
            at = (int(streams[2][3]), at[1])
        ends = []
        for step in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            ends.append(-lm.log_probability(q, x, y).sum() / n)
        assert g[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6), name


def test_lm_learns_held_out_text(sc):
    """Trained, it is far better on held-out documents than before."""
    got = [r for r in lm.score(sc.read.parquet(f"{SMALL}/documents.parquet")).collect() if r.held_out]
    uniform = math.log10(lm.CLASSES * lm.MEMBERS)
    assert sum(r.score for r in got) > -0.75 * uniform * 2.5 * sum(r.n_tokens for r in got)


def test_lm_learns_from_every_training_document(docs_of):
    """In a table said to be large, each document's ids move their rows of the model."""
    rows = [(i, f"{c}{c} " * 9) for i, c in enumerate("bcdfghjklmnpqrstvwxz")]
    path = bpe.tokenizer_path()
    p = lm.train(docs_of(rows), 20_000_000, path)
    coder, first = lm.Subwords(bpe.read_vocabulary(path)), lm.first_parameters()
    for _, text in rows:
        own = set(coder.coder.encode_ordinary(" " + text.strip()))
        assert all((p["ids"][k] != first["ids"][k]).any() for k in own), text


def test_lm_cuts_each_text_once(docs_of, monkeypatch):
    """Counts, training and scores read the ids of one pass over the texts; these are the coder's, word by word."""
    texts = ["", "  two  words ", "émigré Ünïcode 😀 \x00 \x1f 日本語 <|endoftext|>", "\n\none\ttwo one\r", "x" * 3000, None, "A B a b"]
    docs, made, cut = docs_of(list(enumerate(texts))), [], lm.coded

    def kept(docs, *args):
        if "ids" not in docs.columns:
            made.append(args)
        return cut(docs, *args)

    monkeypatch.setattr(lm, "coded", kept)
    assert lm.score(docs).count() == len(texts)
    assert len(made) == 1
    coder = lm.Subwords(made[0][0].value).coder
    got = cut(docs.selectExpr("doc_id", "coalesce(text, '') AS text"), *made[0]).collect()
    for r in got:
        words = (texts[r.doc_id] or "").encode().lower().split()
        want = [k for w in words for k in coder.encode_ordinary(f" {w.decode()}")] + [lm.END]
        assert np.frombuffer(r.ids, np.uint16).tolist() == want


def test_lm_sums_by_id():
    rng = np.random.default_rng(14)
    tokens = rng.integers(0, lm.PAD + 1, (9, lm.WINDOW))
    for kind in (np.float32, np.float64):
        rows = rng.standard_normal((tokens.size, 6)).astype(kind)
        want = np.zeros((lm.PAD + 1, 6))
        np.add.at(want, tokens.reshape(-1), rows)
        want[lm.PAD] = 0
        got = lm._by_id(tokens, rows)
        assert got.dtype == kind and np.allclose(got, want, atol=1e-5)


# --- rows without an id, wide components

def test_mix_of_rows_without_ids(sc):
    """Half of each source has no id: every row is decided on its own."""
    from logspark.llm import mixing

    rng = random.Random(11)
    rows = [(None if i % 2 else i, " ".join(f"w{i}x{j}" for j in range(rng.randrange(1, 30))), "en", "abc"[i % 3], 0) for i in range(900)]
    rows += [(7, f"one id, many texts {i}", "en", "a", 0) for i in range(100)]
    docs = sc.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    none = sc.createDataFrame([], "doc_id long, weight double")
    got = mixing.mix(docs, none).collect()
    assert len(got) == len(rows)
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2
    mixed = collections.Counter(r.text for r in mixing.mixed(docs, none).collect())
    assert sum(mixed.values()) == sum(r.copies for r in got)
    assert sum(n * len(t.split()) for t, n in mixed.items()) == sum(r.taken for r in got)


def test_drawn_rows_without_ids(sc):
    rows = [(None if i % 3 == 0 else i, f"text {i} of many words " + f"x{i % 7} " * (i % 11), "en", "a", 0) for i in range(600)]
    docs = sc.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = sc.createDataFrame([(i, int(i % 2)) for i in range(1, 300)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, 200).collect()
    assert len(kept) == 200
    scored = quality.resample(docs, labels, 200)
    assert scored.filter("kept").count() == 200


def test_the_largest_keys_are_drawn(sc):
    """Gumbel top-k: with k the kept rows are those of the k largest keys."""
    read = sc.read.parquet
    got = quality.resample(read(f"{SF}/documents.parquet"), read(f"{SF}/labels.parquet"), 321).collect()
    ranked = sorted((r.key for r in got), reverse=True)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if r.key >= ranked[320]}


def test_wide_components(sc):
    """Scores against Python's integers, also beyond doubles and longs."""
    rng = random.Random(6)
    rows = [(0, [1.0, 0.0]), (1, [1e8, 5.0]), (2, [5e6, 1.0]), (3, [6e6, -3.0]), (4, [1e15, 1e3]), (20, [2.0 ** 40, -1.0]), (5, [1e30, 7.0])]
    rows += [(i, [rng.uniform(-1, 1) * 10 ** rng.randrange(0, 9), rng.uniform(-1, 1)]) for i in range(21, 80)]
    got = topk.top_k(sc.createDataFrame(rows, "vec_id long, embedding array<double>"), shard=16, block=2).collect()
    v = {i: [max(-(1 << 61), min(1 << 61, math.floor(64 * c))) for c in x] for i, x in rows}
    for q in (0, 20, 40, 60):
        score = {i: max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(v[q], x)))) for i, x in v.items() if i != q}
        want = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:20]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want
