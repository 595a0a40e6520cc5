"""Importance resampling, the quality classifier and cross-tokenizer alignment, against brute force or held-out labels."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perispark.llm import alignment, importance, quality
from perispark.llm.byte_pairs import read_vocabulary
from perispark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n long, rank long, key string, score string, n_links long, quality string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", 3, "z") for i, t in texts], SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---- importance resampling


def brute_resample(rows, target, n, buckets, share, least, seed):
    def grams(text):
        w = WORD.findall(ascii_lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for i, text in rows:
        words, found = grams(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words >= least])
    enough = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(enough[: share * len(enough) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=str)


def some_texts():
    rng = random.Random(11)
    names = [f"Wort{i}" for i in range(40)] + ["é", "ÀB", "日本", "x1"]
    make = lambda n: rng.choice(" -.,\n\t").join(rng.choice(names) for _ in range(n))
    rows = [(i, make(rng.randint(1, 60))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, " .,- "), (203, "one"), (204, "long_word " * 20_000), (5, rows[5][1]), (205, "a" * 50_000)]


@pytest.mark.parametrize(("n", "buckets"), [(1, 97), (2, 1000), (3, 70_000)])
def test_resampling(spark, n, buckets):
    rows, target = some_texts(), ["Wort1 wort2", "WORT3-wort4 é", None, ""]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame(spark, rows), aim, n=n, buckets=buckets, share=25, least_words=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, n, buckets, 25, 20, 7)


def test_resampling_of_odd_tables(spark):
    aim = spark.createDataFrame([("a b",)], "text string")
    assert importance.resample(frame(spark, []), aim).collect() == []
    rows = [(None, "w " * 30), (1, "w " * 30), (2, None)]
    for target in ([], [None]):
        none = spark.createDataFrame([(t,) for t in target], "text string")
        got = importance.resample(frame(spark, rows), none, share=100)
        assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, 2, 10_000, 100, 20, 7)


# ---- quality


def test_features_are_of_words_alone():
    """A word's buckets don't depend on the words around it, and its n-grams are those of the marked bytes."""
    words = ["the", "é", "AND!!", "x", "the"]
    ids, starts = quality.features(words)
    for i, w in enumerate(words):
        own, _ = quality.features([w])
        assert ids[starts[i] : starts[i + 1]].tolist() == own.tolist()
        assert len(own) == 1 + sum(max(0, len(w.encode()) + 3 - k) for k in quality.LENGTHS)
    assert quality.features([])[1].tolist() == [0]


def test_scores_are_softmax_of_averaged_vectors():
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=(quality.BUCKETS, quality.SIZE)).astype(np.float32), rng.normal(size=(2, quality.SIZE + 1)).astype(np.float32))
    for text in ("a b b c", "Word", "", None, "x " * 5000):
        words = (text or "").split()
        ids = [i for w in words for i in quality.features([w])[0]] + [quality.TWICE for a, b in itertools.pairwise(words) if a == b]
        mean = model.vectors[ids].astype(float).mean(axis=0) if ids else np.zeros(quality.SIZE)
        z = model.output[:, :-1].astype(float) @ mean + model.output[:, -1]
        assert model.scores([text])[0] == pytest.approx(np.exp(z[1]) / np.exp(z).sum())


def quality_rows(n):
    rng = random.Random(5)
    names = [f"{a}{b}" for a in ("ta", "re", "mo", "ni") for b in ("len", "sto", "gra")]
    text = lambda bad: " ".join(rng.choice(names) + ("***" if bad and rng.random() < 0.7 else "") for _ in range(rng.randint(5, 60)))
    return [(i, text(i % 3 == 0), int(i % 3 != 0)) for i in range(n)]


def test_quality_on_held_out_labels(spark):
    rows = quality_rows(900)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, "x"), (5000, 0, "x"), (3, None, "x"), (4, 7, "x")], "doc_id long, quality int, text string")
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(6000, None), (6001, ""), (6002, "word " * 50_000), (1, rows[1][1]), (None, "a")])
    model = quality.train(docs, labels, rounds=3)
    out = quality.score_documents(docs, model)
    assert set(out.columns) == set(docs.columns)
    got = [(r.doc_id, r.quality.score, r.quality.predicted) for r in out.collect()]
    assert all(0 <= s <= 1 and p == (s >= 0.7) for _, s, p in got) and len(got) == 905
    truth = {i: y for i, _, y in rows}
    held = [(p, truth[i]) for i, _, p in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and sum(p == y for p, y in held) / len(held) > 0.97
    again = quality.train(docs.repartition(7), labels, rounds=3)  # the walk doesn't depend on how rows lie
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.output, model.output)


def test_quality_never_learns_from_held_out_labels(spark):
    rows = quality_rows(120)
    labels = [(i, y) for i, _, y in rows]
    swapped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (quality.train(frame(spark, [x[:2] for x in rows]), spark.createDataFrame(y, "doc_id long, quality int"), rounds=1) for y in (labels, swapped))
    assert np.array_equal(a.vectors, b.vectors)


def test_quality_without_a_class(spark):
    docs = frame(spark, [(1, "a b"), (2, "c"), (3, None)])
    for labels, want in (([(1, 0), (3, 0)], 0), ([(1, 1)], 1), ([], 1)):
        model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert {r.quality.predicted for r in quality.score_documents(docs, model).collect()} == {want}
    assert quality.score_documents(frame(spark, []), model).collect() == []


# ---- alignment


@pytest.fixture(scope="module")
def files():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
        return read_vocabulary(tokenizer_path()), f.read()


@pytest.fixture(scope="module")
def brute(files):
    """Tokens by the libraries over the whole text, links by comparing all byte ranges of a group."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_str(files[0]), SentencePieceProcessor(model_proto=files[1])
    first.encode_special_tokens = True
    own = alignment.aligner_of(*files)

    def of(text):
        if not text:
            return [], [], {}
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        parts_a = [own.a_bytes[i] for i in a]
        parts_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(parts_a) == (" " + text).encode() == b"".join(parts_b):
            return [], [], {}
        ends = [list(itertools.accumulate(map(len, p))) for p in (parts_a, parts_b)]
        groups, links, i, j = [], Counter(), 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x = [k for k in range(i, len(a)) if ends[0][k] <= cut]
            y = [k for k in range(j, len(b)) if ends[1][k] <= cut]
            i, j = i + len(x), j + len(y)
            groups.append(",".join(str(a[k]) for k in x) + "|" + ",".join(str(b[k]) for k in y))
            for k, m in itertools.product(x, y):
                if max(ends[0][k] - len(parts_a[k]), ends[1][m] - len(parts_b[m])) < min(ends[0][k], ends[1][m]):
                    links[a[k], b[m]] += 1
        return (a, b), groups, links

    return of


def aligned(rows, brute):
    found = [(i, *brute(t)) for i, t in rows]
    count = Counter(p for *_, links in found for p in links)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for i, ids, groups, links in found:
        best = sum(k for p, k in links.items() if count[p] == most[p[0]])
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        sizes = (len(ids[0]), len(ids[1])) if ids else (0, 0)
        out.append((i, *sizes, len(groups), links.total() if links else 0, best, sum(k * count[p] for p, k in links.items()), hashed))
    return sorted(out, key=str)


def odd_texts():
    rng = random.Random(9)
    parts = ["a", "Bc", "é", " ", "  ", "\n", "\t", "\r", "\x1c", "　", "\xa0", "<s>", "<|endoftext|>", "'s", "12", "!!", "日本", "\U0001f600", "x́", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    return texts + ["the cat sat", " lead", "tail ", "\n", " ", "a ▁ b", "<unk><0x41>", "word " * 3000, "!" * 3000, " " * 3000, "naïve–co-op"]


def test_alignment(spark, files, brute):
    texts = odd_texts()
    rows = list(enumerate(texts)) + [(900 + k, "the cat sat") for k in range(40)] + [(3, texts[3]), (None, "the dog"), (950, None), (951, "")]
    got = alignment.align(frame(spark, rows), *files)
    assert sorted(map(tuple, got.collect()), key=str) == aligned(rows, brute)
    assert alignment.align(frame(spark, []), *files).collect() == []
    assert {tuple(r)[1:] for r in alignment.align(frame(spark, [(1, None), (2, "▁")]), *files).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_in_many_blocks(spark, files, brute, monkeypatch):
    """Blocks of a text each, small caches and few texts that count as frequent give the same."""
    rows = [(i, t) for i, t in enumerate(odd_texts()[:60])] + [(100 + k, f"same {k % 3}") for k in range(30)]
    want = aligned(rows, brute)
    one = alignment.aligner_of(*files)
    monkeypatch.setattr(alignment, "CACHE", 5)
    monkeypatch.setattr(alignment, "HOT", 3)
    one.forget()
    parts = [alignment.block_of([t], [1], one) for _, t in rows if t]
    assert sum(int(p["n_links"][0]) for p in parts) == sum(x[4] for x in want)
    assert sorted(map(tuple, alignment.align(frame(spark, rows), *files).collect()), key=str) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '1!é日\n\t\r  \x85\x1f ▁"))))
def test_units_are_the_text(text):
    units = alignment.UNIT.findall(" " + text)
    assert "".join(units) == " " + text
    assert all(re.match(r"[ \n\t]", u) for u in units)


def test_merges_out_of_order_are_refused(files):
    with pytest.raises(ValueError, match="ascend"):
        alignment.Aligner('{"model": {"vocab": {"a": 0, "b": 1, "ab": 3, "ba": 2}, "merges": ["a b", "b a"]}}', files[1])


def test_missing_pairs_of_a_block_are_none(spark, files):
    out = alignment.align(frame(spark, [(1, "x y"), (2, "x y"), (3, "z")]), *files).orderBy("doc_id").collect()
    assert [r.count_sum for r in out][:2] == [r.n_links * 2 for r in out][:2] and all(r.n_best == r.n_links for r in out)
    assert out[0].asDict() | {"doc_id": 2} == out[1].asDict()
