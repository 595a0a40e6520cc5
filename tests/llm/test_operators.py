"""Operators against brute force on small tables with nulls, empty and repeated rows and odd columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perispark.llm import (
    block_search,
    byte_pairs,
    containment,
    fm_dedup,
    license_join,
    lsh_forest,
    secret_scan,
    suffix_tree,
    text_density,
    toxicity,
)
from perispark.llm.common import lower_words

SCHEMA = "doc_id long, text string, n long, class long, component long, secrets string"


def texts():
    rng = random.Random(7)
    names = [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(rng.choice(names) for _ in range(n))
    shared = make(30)
    base = make(120)
    near = base.split()
    near[60] = "changed"
    rows = [make(rng.randint(1, 80)) for _ in range(25)]
    rows += [shared + " " + make(10), make(5) + " " + shared, base, " ".join(near), base.upper(), base.replace(" ", "\n"), "a b " * 40,
        "", " \t\n", "x", "é ü ß"]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts())) + [(3, texts()[3]), (None, texts()[27]), (90, None), (91, "long " * 3000)]
    return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_tree(spark, docs):
    """The base columns by brute force; the tree's score is a log probability that beats it on its own texts."""
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*lower_words(t), None])
    total, kinds = sum(count.values()), len(count)
    base = lambda w: math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1)))
    want = []
    for i, t in rows:
        tokens = [*lower_words(t), None]
        want.append((str(i), held(i), len(tokens), sum(count[w] > 0 for w in tokens), total, round(sum(map(base, tokens)), 6)))
    out = suffix_tree.score_documents(docs, depth=2, p_min=1e-3, divergence=1.0).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)
    assert all(r.score <= 0 for r in out) and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert suffix_tree.score_documents(empty(spark)).collect() == []


def brute_scores(rows, held, share, floor, divergence, prior):
    """log10 probabilities by a tree of depth one over common words, and states of the other words."""
    train = [[*lower_words(t), None] for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    total = sum(count.values())
    common = {w for w, n in count.items() if w is not None and n > share * total}
    symbol = lambda w: w if w is None or w in common else "other"
    rare = {w: n for w, n in count.items() if w is not None and w not in common}
    root = Counter({x: prior for x in (None, "other", *common)})
    for w, n in count.items():
        root[symbol(w)] += n
    size = sum(root.values())
    root = {x: n / size for x, n in root.items()}
    after, after_word = {}, {}
    for t in train:
        for a, b in zip(["start", *t], t):
            if a is not None:
                after.setdefault(symbol(a) if a != "start" else a, Counter())[symbol(b)] += 1
            if a in rare:
                after_word.setdefault(a, Counter())[symbol(b)] += 1

    def state(counts, lower, least):
        """The distribution after a context, or None where it isn't a state."""
        n, kept = sum(counts.values()), {x: k for x, k in counts.items() if k >= least}
        if not kept:
            return None
        rest, mass = n - sum(kept.values()), max(1 - sum(map(lower, kept)), 1e-12)
        gain = sum(k * math.log(k / n / lower(x)) for x, k in kept.items()) + (rest * math.log(rest / n / mass) if rest else 0)
        back = (rest + prior) / (n + prior)
        return (lambda low: lambda x: kept.get(x, 0) / (n + prior) + back * low(x)) if gain >= divergence else None

    first = {s: p(root.get) for s, c in after.items() if (p := state(c, root.get, floor))}
    of_class = first.get("other", root.get)
    words = {w: p for w, c in after_word.items() if (p := state(c, of_class, 2))}
    once, twice = (sum(n == k for n in count.values()) - (count[None] == k) for k in (1, 2))
    discount = min(0.999, (once + 0.5) / (once + 2 * twice + 1))
    rare_n = sum(rare.values())
    left = (discount * len(rare) + 0.5) / (rare_n + 0.5)

    def score(text):
        out, last = 0.0, "start"
        for w in [*lower_words(text), None]:
            lower = first.get(last if last == "start" else symbol(last), root.get)
            p = words[last](lower) if last in words else lower
            out += math.log10(p(symbol(w)))
            if w is not None and w not in common:
                out += math.log10((rare[w] - discount) / (rare_n + 0.5) if w in rare else left)
            last = w
        return out

    return score, len(words)


def test_states_of_other_words(spark):
    """Words that aren't common are contexts of their own: by brute force."""
    rng = random.Random(8)
    usual, names = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(40)]

    def text():
        out = []
        for _ in range(30):
            w = rng.choice(names)
            out += [w, usual[hash_of(w) % 6]] if rng.random() < 0.8 else [rng.choice(usual)]
        return " ".join(out)

    hash_of = lambda w: zlib.crc32(w.encode())
    rows = [(i, text()) for i in range(60)] + [(60, None), (61, "new r1 words"), (61, "r2 c1"), (None, "r3")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    score, states = brute_scores([(i, t or "") for i, t in rows], held, 0.03, 5, 8.0, 1.0)
    assert states > 10
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = suffix_tree.score_documents(d, depth=1, p_min=1e-9, divergence=8.0, common_share=0.03, least=5).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in out) == sorted((str(i), round(score(t), 6)) for i, t in rows)


def test_suffix_tree_sums_to_one():
    root = np.array([0, 0, 0.2, 0.3, 0.5])
    tree = suffix_tree.Tree(2, root)
    keys = np.array([4 << 16, 4 << 16 | 4, 4 << 16 | 3])
    tree.grow(1, keys, np.array([10.0, 7.0, 3.0]), 2.0, 0.0, 1.0)
    assert len(tree.states) == 2
    total = tree.prob(np.full(3, 1), np.array([2, 3, 4])).sum()
    assert abs(total - 1) < 1e-9


def brute_spans(text):
    found = [(m.start(), m.end(), "assign") for m in secret_scan.ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(found, key=lambda x: (x[0], secret_scan.KINDS.index(x[2])))


def test_secrets(spark, docs):
    secret = "NqVwYS81VP7Hb1DX8pPd5khxE3pyIgKp"
    hexes = "0f3a9c4e" * 4 + "7d"
    text = f'note password = "hunter2hunter2" AKIA{"A1B2" * 4} {hexes} plain words {secret} end'
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "ſecret: abcdefghi"),
        (None, "the quick brown fox jumps over the lazy dog and sleeps " * 400)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, secrets string")
    found = secret_scan.digest(secret_scan.find_secrets(d)).collect()
    assert len(found) == len(rows)
    for r in found:
        t = dict((i, x) for i, x in rows)[r.doc_id] or ""
        base = brute_spans(t)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for *_, k in base) for kind in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in base).encode()).hexdigest()
        assert all(f"{k}:{s}:{e}" in r.spans.split(",") for s, e, k in base)
        assert ("random" in r.spans) == (r.doc_id == 1)
    red = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.find_secrets(d)).collect()}
    assert "hunter2" not in red[1] and secret not in red[1] and hexes not in red[1] and red[2] is None and red[None] == rows[-1][1]
    assert secret_scan.find_secrets(empty(spark)).collect() == []


def test_planted_secrets(spark):
    """Random strings of every encoding are found among prose, and prose isn't."""
    rng = random.Random(5)
    sounds = "an en in ber lich keit sch tion ment que ciu dad los ver ge".split()
    prose = lambda: " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 8))) for _ in range(150))
    letters = {n: a for n, a in secret_scan.ENCODINGS if n != "digits"}
    rows, planted = [], {}
    for name, alphabet in letters.items():
        for size in (24, 32, 40):
            for _ in range(4):
                secret = "".join(rng.choice(alphabet) for _ in range(size))
                planted[len(rows)] = (name, secret)
                rows.append((len(rows), f"{prose()} {secret} {prose()}"))
    rows += [(len(rows) + i, prose()) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    red = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.find_secrets(d)).collect()}
    caught = sum(secret not in red[i] for i, (_, secret) in planted.items())
    assert caught >= 0.95 * len(planted)
    assert sum(red[i] != t for i, t in rows if i not in planted) <= 1


def test_remainder_of_a_run():
    assert list(secret_scan.outside(0, 10, [(2, 4, "hex"), (3, 6, "hex"), (12, 14, "hex")])) == [(0, 2), (6, 10)]
    assert secret_scan.encoding("3f2504e0-4f89-11d3-9a0c-0305e82c3301")[0] == "hex" and secret_scan.encoding("Ab_-9")[0] == "base64"


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"wort{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        w = [rng.choice(words) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "gemein"
        rows.append((i, ". ".join(w)))
    d = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(400)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.toxicity for r in toxicity.score_documents(d, toxicity.train(d, labels)).collect()}
    assert sum(out[i].predicted == (i % 4 == 0) for i in range(400)) >= 396 and not out[900].predicted
    bad = [(i, out[i].offending) for i in range(0, 400, 4) if out[i].predicted]
    assert all("gemein" in rows[i][1][s["start"] : s["end"]] for i, o in bad for s in o)
    assert toxicity.train(empty(spark), labels.limit(0)).score("x") < 0.5
    model = toxicity.train(d, labels)
    odd = spark.createDataFrame([(1, "gemein", "x"), (1, "gemein", "x"), (None, None, "y")], "doc_id long, text string, toxicity string")
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == 3 and scored[0] == scored[1] and scored[0].toxicity.score == pytest.approx(model.score("gemein"))
    assert toxicity.score_documents(empty(spark), model).collect() == []
    bare = toxicity.score_documents(odd, model, least=None).select("toxicity.*")
    assert bare.columns == ["score", "predicted"] and [r.predicted for r in bare.collect()] == [r.toxicity.predicted for r in scored]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, k, percent):
    rows = [(r.doc_id, set(containment.shingles(lower_words(r.text), k))) for r in docs.collect()]
    comp = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i, x in rows:
            for j, y in rows:
                if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    out = lsh_forest.near_duplicates(docs, k=k, percent=percent).collect()
    assert len(out) == docs.count()
    assert all(r.component_id == comp.get(r.doc_id) and r.kept == (r.doc_id is None or comp[r.doc_id] == r.doc_id) for r in out)
    assert lsh_forest.near_duplicates(empty(spark)).collect() == []


def test_link_in_a_large_region(spark):
    rng, hasher = random.Random(11), containment.Hasher(3)
    sign = lambda words: lsh_forest.signature(np.unique(hasher([w.encode() for w in words])))
    one = [f"w{i}" for i in range(60)]
    of_one, own = sign(one), hasher([w.encode() for w in one])
    prefixes = (lambda sig,
        depth: [np.array_equal(sig[(4 * t + np.arange(depth)) % 64], of_one[(4 * t + np.arange(depth)) % 64]) for t in range(16)])
    while True:  # alike, but their signatures share four columns of a single order and no deeper prefix
        other = list(one)
        for i in rng.sample(range(60), 4):
            other[i] = f"x{rng.random()}"
        shares = prefixes(sign(other), 4)
        if sum(shares) == 1 and not any(prefixes(sign(other), 6)):
            break
    cols = 4 * shares.index(True) + np.arange(4)
    least = (own[None] * lsh_forest.FACTORS[cols, None] + lsh_forest.SHIFTS[cols, None]).argmin(axis=1).tolist()
    rows = [one, other]
    while len(rows) < 302:  # texts of the same region that are like nothing
        words = [w for at in least for w in [*one[at : at + 3], *(f"u{rng.random()}" for _ in range(3))]]
        if np.array_equal(sign(words)[cols], of_one[cols]):
            rows.append(words)
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    for how in ({}, {"block": 16, "grid": 3}, {"block_bytes": 9000, "grid": 2}):  # one block, and cells of many
        out = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(d, percent=60, **how).collect()}
        assert out == {i: i if i != 1 else 0 for i in range(302)}


def test_cells_hold_each_pair_of_blocks_once(spark):
    rows = [(1, b, [b], b % 3 == 0) for b in range(11)] + [(2, 0, [100], True), (2, 1, [101], False), (3, 0, [200], False)]
    blocks = spark.createDataFrame(rows, "key long, block long, part array<long>, some boolean")
    cells = lsh_forest._cells(blocks, 2)
    got = sorted((r.left[0], r.right[0]) for r in cells.collect())
    assert got == sorted([(a, b) for a in range(0, 11, 3) for b in range(11)] + [(100, 100), (100, 101)])


def test_regions_of_one_block_are_not_dealt(spark, monkeypatch):
    given, cells = [], lsh_forest._cells
    monkeypatch.setattr(lsh_forest, "_cells", lambda blocks, grid: given.append(blocks.count()) or cells(blocks, grid))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = [" ".join(rng.choice(base[i : i + 2]) if rng.random() < 0.2 else w for i, w in enumerate(base)) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    one = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(d, percent=60).collect()}
    many = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(d, percent=60, block=4, grid=2).collect()}
    assert given[0] == 0 < given[1] and one == many


def test_sets_only_of_texts_in_the_filter(spark):
    bits = containment.value_filter(spark.createDataFrame([(5,)], "value long"))
    batch = pa.RecordBatch.from_arrays([pa.array(["a b c", "d e f"]), pa.array([5, 6])], ["text", "place"])
    [out] = lsh_forest._sets(iter([batch]), bits, 3)
    own = np.unique(containment.Hasher(3)([b"a", b"b", b"c"]))
    assert out.to_pylist() == [{"class": lsh_forest.class_of(own), "own": own.tobytes()}]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (500, [0.0] * 8), (600, [float("nan")] * 8), (None, [1.0] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = {}
    for r in block_search.nearest(d.filter("vec_id % 100 = 0"), d, vector_block=64).orderBy("rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(out) == {0, 100, 200}
    for q, got in out.items():
        dist = block_search.distances(np.repeat(v[q : q + 1].astype(float), 300, 0), v.astype(float))
        want = sorted((dist[i], i) for i in range(300) if i != q)[:10]
        assert got == [(i, x) for x, i in want]
    assert block_search.nearest(d.limit(0), d).collect() == []
    wide = (
        spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 3e199]), (2, [-1e200, 0.0]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0])],
        "vec_id long, embedding array<double>"))
    rows = block_search.nearest(wide.filter("vec_id IN (0, 3)"), wide, k=2).collect()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows}
    assert got[0, 1] == (1, pytest.approx(3e199)) and got[0, 2][0] == 3 and got[3, 1] == (4, pytest.approx(2e-200)) and got[3, 2][0] == 0


def brute_licenses(text, containment=0.85):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_join.PHRASES:
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    base, best = ",".join(sorted(labels)), 0.0
    for label, template in license_join.TEMPLATES:
        own, width = set(template.lower().split()), math.ceil(len(template.split()) / containment)
        share = max((len(own & set(words[i : i + width])) for i in range(len(words))), default=0)
        if share >= math.ceil(containment * len(own) - 1e-9):
            labels.add(label)
            best = max(best, share / len(own))
    score = 1.0 if places else best
    return len(words), len(places), min(places, default=None), max(places, default=None), base, ",".join(sorted(labels)), round(score, 9)


def test_licenses(spark, docs):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated\n "
        "documentation files")
    more = ["Released under the MIT License.\ncc by CC-BY cc by", mit, f"x {mit.replace('granted', 'given')} y",
        mit.replace("free of charge", "x " * 30)]
    more += ["Licensed\nunder the Apache\tLicense Version 2", "this software is provided", "permission " * 300,
        "GNU general public license" + " gnu" * 50]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(200 + i, t) for i, t in enumerate(more)] + [(201, mit), (None, mit)]
    d = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, labels string, near long")
    out = license_join.scan_licenses(d).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = [(str(r.doc_id), *(round(r[n], 9) if n == "score" else r[n] for n in names)) for r in out]
    assert sorted(got, key=str) == sorted([(str(i), *brute_licenses(t)) for i, t in rows], key=str)
    assert sum("text-mit" in r.labels for r in out) == 4
    assert license_join.scan_licenses(empty(spark)).collect() == []


def test_main_text():
    page = ('<html><body><nav><a href="/">x</a></nav><div class="sidebar">s</div><article><h1>T &amp; u</h1><p>one '
        '<b>two</b><br>three<p>four</article><section class="comments"><p>no</p></section><footer>f</footer></body></html>')
    assert text_density.extract(page) == "T & u one two three four"
    assert text_density.extract("") == "" and text_density.extract("<p>just a line of text</p>") == "just a line of text"
    long, more = "word " * 80, "more " * 60
    teaser = (f'<main><article><h1>T</h1><p>{long}<p>{more}</article><article><h3>Read</h3><a href=x>next '
        f'one</a><p>short</p></article></main>')
    assert text_density.extract(teaser) == f"T {long}{more}".strip()
    split = (f"<body><div><h1>T</h1><p>{long}</p></div><div><p>{more}</p><p>end</p></div><ul><li><a href=x>one</a><li><a "
        f"href=y>two</a></ul></body>")
    assert text_density.extract(split) == f"T {long}{more}end"
    assert text_density.extract(f'<div class="content-sidebar-wrap"><h1>T</h1><p>{long}</p></div>') == f"T {long}".strip()


def brute_densities(page):
    """Density and density sum of each element, by plain recursion over a tree of nested lists."""
    def build(tokens):
        out = []
        while tokens:
            t = tokens.pop(0)
            if t.startswith("</"):
                return out
            out.append((t.strip("<>"), build(tokens)) if t.startswith("<") else t)
        return out

    def sums(node, linked):
        name, children = node
        c = t = links = k = 0
        for x in children:
            if isinstance(x, str):
                c += len(x.strip())
                links += len(x.strip()) if linked or name == "a" else 0
            else:
                a = sums(x, linked or x[0] == "a")
                c, t, links, k = c + a[0], t + a[1] + 1, links + a[2], k + a[3] + (x[0] == "a")
        return c, t, links, k

    tree = build(re.findall(r"</?\w+>|[^<]+", page))[0]
    body = sums(tree, False)
    share, out = body[2] / max(1, body[0]), []

    def walk(node, linked):
        name, children = node
        linked = linked or name == "a"
        c, t, links, k = sums(node, linked)
        t, links_, k = max(1, t), max(1, links), max(1, k)
        d = 0.0
        if c:
            d = c / t * math.log(c / links_ * t / k, math.log(c / max(1, c - links) * links_ + share * c + math.e))
        at = len(out)
        out.append([name, max(0.0, d), 0.0])
        for x in children:
            if not isinstance(x, str):
                out[at][2] += walk(x, linked)
        return out[at][1]

    walk(tree, False)
    return out


def test_densities():
    rng = random.Random(4)
    text = lambda n: " ".join("wort" for _ in range(n))

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return text(rng.randint(1, 40))
        name = rng.choice(("div", "section", "span", "a") if depth < 3 else ("div", "section"))
        return f"<{name}>{''.join(element(depth - 1) for _ in range(rng.randint(1, 4)))}</{name}>"

    for _ in range(30):
        page = f"<body>{''.join(element(4) for _ in range(3))}</body>"
        nodes = text_density.parse(page)
        body, _ = text_density.measure(nodes, set())
        want = brute_densities(page)
        assert [n.name for n in nodes[1:]] == [x[0] for x in want]
        assert np.allclose([n.density for n in nodes[1:]], [x[1] for x in want]) and np.allclose([n.total for n in nodes[1:]],
            [x[2] for x in want])
        assert body.best.total == max(n.total for n in nodes[1:] if n.chars)


def test_pages(spark):
    page = "<article><h1>A</h1><p>one two three</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (None, "u", "<p>" + "long " * 50_000, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = text_density.extract_pages(d).collect()
    assert sorted((str(r.page_id), r.text) for r in out) == sorted(
        [("1", "A one two three")] * 2 + [("2", ""), ("3", ""), ("None", ("long " * 50_000).strip())]
    )
    assert text_density.extract_pages(d.limit(0)).collect() == []


@pytest.mark.parametrize("page",
    ["<div>" * 50_000 + "x", "<p>x" + "</div>" * 50_000, "<b>" * 25_000 + "<h1>x</h1>" * 25_000,
    "<p><td>" + "<b>" * 25_000 + "<h1>x</h1>" * 25_000])
def test_hostile_pages(page):
    began = time.time()
    text_density.extract(page)
    assert time.time() - began < 5


def test_renamed_articles():
    """The given pages' text doesn't hang on the names of their elements."""
    import duckdb

    pages = duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall()
    for (page,) in pages:
        assert text_density.extract(re.sub(r"<(/?)(article|main)\b", r"<\1div", page)) == text_density.extract(page)


def test_backward_search():
    rng = np.random.default_rng(1)
    for window, letters in ((2, 1), (3, 2), (5, 2), (8, 3), (20, 1), (20, 2)):
        symbols, begin, length = [], [], []
        for _ in range(20):
            begin.append(len(symbols))
            length.append(window + int(rng.integers(0, 14)))
            symbols += [*(rng.integers(1, letters + 1, length[-1]) if rng.random() < 0.6 else [1] * length[-1]), 0]
        symbols = np.array(symbols, np.int64)
        places = {}
        for b, n in zip(begin, length, strict=True):
            for i in range(b, b + n - window + 1):
                places.setdefault(tuple(symbols[i : i + window]), []).append(i)
        want = {i: p for p in places.values() if len(p) > 1 for i in p}
        at, low, high, suffixes = fm_dedup.repeated(symbols, np.array(begin), np.array(length), window)
        assert {i: sorted(suffixes[x:y].tolist()) for i, x, y in zip(at.tolist(), low, high, strict=True)} == want


def test_word_hashes(monkeypatch):
    words = list(dict.fromkeys(w.encode() for t in texts() for w in t.split())) + [b"x" * 20_000]
    hasher = containment.Hasher(1)
    together = hasher.words(words)
    assert len(np.unique(together)) == len(words) and [int(hasher.words([w])[0]) for w in words] == together.tolist()
    monkeypatch.setattr(containment, "TOGETHER", 7)
    assert hasher.words(words).tolist() == together.tolist()


def test_repeats(spark, docs):
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None})
    seen, want = set(), {}
    for i, t in rows:
        w = t.encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            x = tuple(w[s : s + 20])
            if x in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(x)
        want[i] = (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(a for a, b in zip(w, keep, strict=True) if b)).hexdigest())
    out = fm_dedup.remove_repeats(docs).collect()
    assert len(out) == docs.count()
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in out if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in out if r.doc_id is None)
    hot = fm_dedup.remove_repeats(docs, hot_segments=0).collect()
    assert sorted(map(str, hot)) == sorted(map(str, out))
    assert fm_dedup.remove_repeats(empty(spark)).collect() == []


def test_hot_passage(spark, monkeypatch, tmp_path):
    passage = [f"p{i}" for i in range(24)]
    rows = ([(i, " ".join([f"a{i}", f"b{i}", *passage, f"c{i}", f"d{i}"])) for i in range(150)]
        + [(i, " ".join([*passage[:21], f"e{i}"])) for i in range(150, 160)])
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    usual, folder = fm_dedup._shards, str(tmp_path)

    def noted(batches, window, shard_words):
        import os
        from collections import Counter

        batches = list(batches)
        groups = Counter(x for b in batches for x in b.column("group" if "group" in b.schema.names else "anchor").to_pylist())
        if groups:
            open(f"{folder}/{max(groups.values())}-{os.urandom(8).hex()}", "w").close()
        return usual(iter(batches), window, shard_words)

    whole = {r.doc_id: r.n_removed for r in fm_dedup.remove_repeats(d).collect()}
    monkeypatch.setattr(fm_dedup, "_shards", noted)
    out = {r.doc_id: r.n_removed for r in fm_dedup.remove_repeats(d, hot_segments=20).collect()}
    assert out == whole == {i: 0 if i == 0 else 24 if i < 150 else 21 for i in range(160)}
    assert max((int(f.name.split("-")[0]) for f in tmp_path.iterdir()), default=0) <= 20


def test_fm_index():
    rng = np.random.default_rng(2)
    s = rng.integers(1, 5, 400)
    s[::50] = 0
    index = fm_dedup.FMIndex(s, 8)
    for i in range(0, 390, 7):
        p = s[i : i + 5]
        if (p == 0).any():
            continue
        low, high = index.first[p[-1:]], index.first[p[-1:] + 1]
        for c in p[-2::-1]:
            low, high = index.step(np.array([c]), low, high)
        assert int(high[0] - low[0]) == sum(np.array_equal(s[j : j + 5], p) for j in range(396))


def test_byte_pairs(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, v = tokenizers.Tokenizer.from_file(path), byte_pairs.read_vocabulary(path)
    odd = spark.createDataFrame([(300, "a <|endoftext|>  b\n\n'll 🙂 aaaaaaa"), (301, None)], "doc_id long, text string")
    clash = docs.select("doc_id", "text").unionByName(odd).withColumns({"ids": F.lit("x"), "together": F.lit(1)})
    rows = byte_pairs.encode(clash, v, decoded_col="together")
    assert rows.columns == ["doc_id", "text", "ids", "together"]
    for r in byte_pairs.decode(rows, v).collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == r.together == t.decode(want, skip_special_tokens=False)


def test_containment(spark, docs):
    items = (
        spark.createDataFrame(
        [(1, " ".join(texts()[25].split()[:25])), (2, "x"), (3, None), (None, "x"), (4, ""), (5, "not there at all really"), (2, "x"),
        (2, "a b a b a b")], "item_id long, text string"))
    want = set()
    for d in docs.collect():
        own = set(containment.shingles(lower_words(d.text), 5))
        for r in items.collect():
            q = set(containment.shingles(lower_words(r.text), 5))
            if r.item_id is not None and q and len(q & own) >= 0.8 * len(q):
                want.add((d.doc_id, r.item_id))
    out = containment.find_items(docs, items)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want and want
    texts_of_2 = [r for r in out.collect() if r.item_id == 2 and r.doc_id == 31]
    assert [r.n_shingles for r in texts_of_2] == [2]
    assert containment.find_items(empty(spark), items).collect() == [] and containment.find_items(docs, items.limit(0)).collect() == []


def test_containment_of_planted_items(spark):
    """Items of each size class, whole or in pieces far apart, of which a fifth of the shingles at most is spoilt."""
    rng = random.Random(5)
    make = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    items, docs, want = [], [], set()
    for i, n in enumerate((3, 6, 12, 15, 30, 60, 100, 200, 400, 900) * 20):
        words = make(n)
        items.append((i, " ".join(words)))
        own = list(words)
        if n >= 60:  # each changed word spoils five shingles
            for at in rng.sample(range(n), n // 30):
                own[at] = "changed"
        docs.append((i, " ".join(make(rng.randrange(300)) + own + make(rng.randrange(300)))))
        q, held = (set(containment.shingles(lower_words(t), 5)) for t in (items[-1][1], docs[-1][1]))
        if len(q & held) >= 0.8 * len(q):
            want.add((i, i))
    docs.append((1000, " ".join(make(100_000) + items[8][1].split() + make(100_000))))
    out = containment.find_items(spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want | {(1000, 8)} and len(out) == len(want) + 1 > 170
    assert all(r.containment == r.n_shared / r.n_shingles for r in out)


def test_filter_of_values_sets_their_bits(spark):
    values = [0, 1, -1, 1 << 27, (1 << 27) - 1, 32767, 32768, 5_000_000_000, -(1 << 63)]
    bits = containment.value_filter(spark.createDataFrame([(v,) for v in values], "value long"))
    wanted = sorted({v & (containment.FILTER_BITS - 1) for v in values})
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == wanted


def shuffled(spark, df):
    """The rows of df, and the bytes that making them shuffled."""
    context = spark.sparkContext

    def so_far():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = so_far()
    return df.collect(), so_far() - before


@pytest.mark.parametrize("operator", ["keep_one", "remove_contaminated"])
def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, operator):
    """However many ids go: broadcasts are off, as they are for a large table of ids."""
    random_text = lambda i: random.Random(i).randbytes(5000).hex()
    spread = spark.range(400).withColumnRenamed("id", "doc_id").repartition(4)
    docs = spread.withColumn("text", F.udf(random_text)("doc_id")).withColumn("_id", F.lit("own")).cache()
    gone = spark.range(0, 400, 3).select(F.col("id").alias("doc_id"), F.lit(False).alias("kept"))
    monkeypatch.setattr(lsh_forest, "near_duplicates", lambda *a, **k: gone)
    monkeypatch.setattr(containment, "find_items", lambda *a, **k: gone)
    docs.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lsh_forest.keep_one(docs) if operator == "keep_one" else containment.remove_contaminated(docs, None)
        rows, moved = shuffled(spark, out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, rows)) == [(i, random_text(i), "own") for i in range(400) if i % 3]
    assert moved < 100_000  # the texts are 2.7 MB


@pytest.mark.parametrize("bits", [8, 1 << 10, 1 << 16, 1 << 27])
def test_ids_that_share_bits_stay(spark, monkeypatch, bits):
    """Exact, however full the filters are: null and repeated ids, and ids that docs doesn't hold."""
    monkeypatch.setattr(containment, "FILTER_BITS", bits)
    rows = [(i, f"t{i}") for i in range(-500, 500)] + [(None, "no id"), (None, None), (7, "again"), (8, "again")]
    docs = spark.createDataFrame(rows, "name int, text string")
    gone = [i for i in range(-500, 2000) if i % 4 == 3]
    table = spark.createDataFrame([(i,) for i in [*gone, 7, None]], "doc_id long")
    out = containment.without(docs, table, id_col="name")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([r for r in rows if r[0] is None or r[0] % 4 != 3], key=str)
    assert containment.without(docs.limit(0), table, id_col="name").collect() == []
    assert containment.without(docs, table.limit(0), id_col="name").count() == len(rows)


def brute_groups(rows, k, percent):
    """The ids of which one stays: the least of each group of linked texts."""
    sets = {i: set(containment.shingles(lower_words(t), k)) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in where[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                comp[max(a, b)] = min(a, b)
    return {i for i in sets if root(i) == i}


def test_pipeline(spark):
    """Each stage against brute force on its own input, on the smallest given tables."""
    import corpus_pipeline as P

    tokenizers = pytest.importorskip("tokenizers")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = (
        spark.createDataFrame([(None, "no id", None, None, None), (90_001, None, "en", "a", 0), (90_002, "", None, "a", 0)], docs.schema))
    docs = docs.unionByName(odd).cache()
    stages = dict(P.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    model = toxicity.train(docs, labels)
    kept = stages["toxicity"](spark, docs, sf).cache()
    assert kept.columns == list(P.COLUMNS)
    assert sorted(rows(kept), key=str) == sorted([(i, t) for i, t in rows(docs) if model.score(t or "") < 0.5], key=str)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    clean, left = {r.doc_id for r in labels.filter("toxic = 0").collect()}, {i for i, _ in rows(kept)}
    assert len(clean & left) >= 0.98 * len(clean) and len(toxic & left) <= 0.5 * len(toxic), (len(clean), len(clean & left), len(toxic), len(toxic & left))

    once = stages["near_dedup"](spark, kept, sf).cache()
    stay = brute_groups([(i, t) for i, t in rows(kept) if i is not None], 5, 80)
    assert once.columns == list(P.COLUMNS) and sorted(i for i, _ in rows(once) if i is not None) == sorted(stay)

    clean = stages["decontamination"](spark, once, sf).cache()
    items = [set(containment.shingles(lower_words(r.text), 5)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = (lambda t: any(q and len(q & own) >= 0.8 * len(q) for own in [set(containment.shingles(lower_words(t), 5))] for q in items))
    assert sorted(rows(clean), key=str) == sorted([(i, t) for i, t in rows(once) if not held(t)], key=str)

    red = stages["secret_scan"](spark, clean, sf).cache()
    before = dict(rows(clean))
    assert red.columns == list(P.COLUMNS) and {i for i, _ in rows(red)} == set(before)
    for r in red.collect():
        t = before[r.doc_id]
        assert (r.text is None) == (t is None) and (t is None or not brute_spans(r.text.replace("[SECRET]", " ")))
        assert t is None or brute_spans(t) or r.text == t or "[SECRET]" in r.text
        assert r.n_chars == (None if t is None else len(r.text))

    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = stages["byte_pairs"](spark, red, sf).collect()
    assert len(out) == red.count() and all(r.ids == t.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
        for r in out)
    whole = {r.doc_id for r in P.run(spark, sf).select("doc_id").collect()}
    assert whole == {r.doc_id for r in out} - {None, 90_001, 90_002} | (whole & {90_001, 90_002})


def test_pipeline_of_nothing(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.count() == 0


def test_shared_folder(spark):
    from types import SimpleNamespace

    from perispark.llm.common import shared_folder

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(fake)


LONG = "Some words of a long paragraph that goes on, and on, as articles do. " * 6


@pytest.mark.parametrize(("page", "want"), [
    # a form around the whole page is no form of it; its controls are
    (f'<body><form id="aspnetForm"><nav><a href=x>Home</a></nav><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><input><label>Search</label>'
     "<button>Go</button></form></body>", f"T {LONG}{LONG}"),
    # parts of an article that are named like parts of a page
    (f'<body><article><div class="entry-header"><h1>T</h1></div><p>{LONG}</p><p>{LONG}</p></article></body>', f"T {LONG}{LONG}"),
    (f'<body><article><h1>T</h1><p>{LONG}</p><section class="related-work"><h2>R</h2><p>{LONG}</p><p>end</p></section></article></body>',
     f"T {LONG}R {LONG}end"),
    # what isn't the article's goes as before: mostly links, readers' comments, a form to reply
    (f'<body><article><h1>T</h1><p>{LONG}</p><div class="related"><a href=x>One more story</a> <a href=y>Another one</a></div>'
     "<div class='comments'><p>Nice, says a reader.</p></div><form><p>Leave a reply</p><input></form></article></body>", f"T {LONG}"),
    (f'<body><div class="related"><p>{LONG}</p></div><main><h1>T</h1><p>{LONG}</p><p>{LONG}</p></main></body>', f"T {LONG}{LONG}"),
])
def test_forms_and_parts_of_articles(page, want):
    assert text_density.extract(page) == want.strip()
