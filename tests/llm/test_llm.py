"""The ten operators against brute force, round trips and held-out accuracy, and on hard rows."""

import bisect
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, components, context_mixing, decontamination, jaccard, language, media, packing, quality, registry, repeats, text_mixing, token_counts, toxicity
from ledgerloom.llm.common import Scratch, table

P = pytest.importorskip("public_tokenizers")


def prose(seed: int, n: int, many: int = 300) -> str:
    rng = random.Random(seed)
    return " ".join(hashlib.md5(str(int(rng.paretovariate(0.7)) % many).encode()).hexdigest()[: 2 + int(rng.random() * 6)] for _ in range(n))


def collect(df):
    return [r.asDict(True) for r in df.collect()]


# --- 1 toxicity -----------------------------------------------------------------------------------------

def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    total, hit = 0.0, np.zeros(5)
    for m in range(32):
        y = [(m >> i) & 1 for i in range(5)]
        w = math.exp(sum(e[0, i] * y[i] for i in range(5)) + sum(a[y[i], y[i + 1]] for i in range(4)))
        total += w
        hit += w * np.array(y)
    p, pairs, z = toxicity.forward_backward(e, a)
    assert np.allclose(p[0], hit / total) and pairs.sum() == pytest.approx(4) and z[0] == pytest.approx(math.log(total))
    field = toxicity.Field()
    field.transition, field.trained = a, True
    assert np.allclose(field.marginals(e[0], np.array([5])), hit / total)
    assert np.allclose(field.marginals(np.concatenate((e[0], e[0][:2])), np.array([5, 2, 0]))[:5], hit / total)


def test_toxicity_held_out(spark, tiny):
    d = tiny.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    field = toxicity.fit(docs, labels)
    held = docs.join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0), "doc_id")
    got = {(r["doc_id"], r["predicted"]) for r in collect(toxicity.toxicity(held, field))}
    truth = {(r["doc_id"], r["toxic"]) for r in held.select("doc_id", "toxic").collect()}
    assert len(got & truth) / len(truth) > 0.965
    some = collect(toxicity.toxicity(held.where("toxic = 1"), field))
    assert sum(bool(r["spans"]) for r in some) > 0.8 * len(some)
    texts = {r["doc_id"]: r["text"] for r in held.select("doc_id", "text").collect()}
    assert all(re.fullmatch(r"\w+(\W+\w+)*", texts[r["doc_id"]][s["start"] : s["end"]]) for r in some for s in r["spans"])


def test_marginals_of_ragged_rows():
    """Side by side, one by one and both together, against the rows alone."""
    rng = np.random.default_rng(3)
    field = toxicity.Field()
    field.transition, field.trained = rng.normal(size=(2, 2)), True
    for sizes in ([5], [1, 2, 3], [7, 0, 300, 9, 9, 9, 1, 200], [4] * 9, [2] * 6 + [90, 80]):
        sizes = np.array(sizes)
        e = rng.normal(size=sizes.sum()) * 3
        got = np.split(field.marginals(e, sizes), np.cumsum(sizes)[:-1])
        for row, p in zip(np.split(e, np.cumsum(sizes)[:-1]), got, strict=True):
            assert not len(row) or np.allclose(toxicity.forward_backward(row[None], field.transition)[0][0], p)


def test_tags_follow_the_words_around():
    """A word that is toxic behind one word alone is tagged there alone."""
    rng = random.Random(2)
    names = [f"w{i}" for i in range(30)] + ["you", "the", "snake"]
    docs, tags = [], []
    for i in range(400):
        d = [rng.randrange(30) for _ in range(20)]
        d[8], d[9] = (30, 32) if i % 2 else (31, 32)
        docs.append(np.array(d))
        tags.append(np.array([int(i % 2 and k == 9) for k in range(20)]))
    field = toxicity.Field()
    field.train(docs, tags, names)
    known = toxicity._Emissions(field)
    found = [known.scores(t) for t in ("w1 w2 you snake w3", "w1 w2 the snake w3")]
    p = field.marginals(toxicity.in_context(*np.concatenate(found).T, np.array([5, 5])), np.array([5, 5]))
    assert p[3] > 0.8 and p[8] < 0.2 and np.delete(p, [3]).max() < 0.2


def test_long_texts_are_read_in_pieces(monkeypatch):
    field = toxicity.Field()
    field.weights = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)
    text = " ".join(f"w{i % 700}" for i in range(5000)) + " \n" * 50
    want = toxicity._Emissions(field).scores(text)
    monkeypatch.setattr(toxicity, "text_pieces", lambda t, b: common.text_pieces(t, b, 1000))
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 100)
    assert len(list(common.text_pieces(text, toxicity._OTHER, 1000))) > 5 and "".join(common.text_pieces(text, toxicity._OTHER, 1000)) == text
    assert np.array_equal(toxicity._Emissions(field).scores(text), want) and list(common.text_pieces("x" * 99, toxicity._OTHER, 10)) == ["x" * 99]


def test_toxicity_hard(spark, hard, empty, labels):
    field = toxicity.fit(hard, labels)
    got = collect(toxicity.toxicity(hard, field))
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# --- 2 media ----------------------------------------------------------------------------------------------

def test_payload_round_trip(spark, hard):
    got = collect(media.store_payloads(hard).join(media.jpeg_columns(media.store_payloads(hard)).withColumnRenamed("id", "doc_id"), "doc_id"))
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in hard.where("doc_id IS NOT NULL").collect()}
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        t = texts[r["doc_id"]]
        n = max(1, -(-len(t) // 576)) * 576
        assert r["thumbnail"] == t + b"\xff" * (n - len(t)) and r["error"] is None


def test_media_digests_by_brute_force(spark, tiny):
    """Every digest column of the query from the texts alone; equal texts have equal values."""
    got = {r["doc_id"]: r for r in collect(registry.QUERIES["op2_media_columns"](spark, tiny))}
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, tiny, "documents").select("doc_id", "text").collect()}
    assert set(got) == set(docs)
    stored = {r["doc_id"]: bytes(r["media"]) for r in collect(media.store_payloads(table(spark, tiny, "documents")))}
    by_text = defaultdict(set)
    for doc, t in docs.items():
        payload = t + b"\xff" * (max(1, -(-len(t) // 576)) * 576 - len(t))
        r = got[doc]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(t), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[doc]), hashlib.sha256(stored[doc]).hexdigest())
        by_text[t].add((r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_many_images():
    data = np.random.default_rng(1).integers(0, 256, 576 * 8200, dtype=np.uint8)
    small = data[:1152]
    stored = media.write_payloads(np.concatenate((small, data, small)), np.array([1152, len(data), 1152]))
    assert stored[0] == stored[2] == media.write_payloads(small, np.array([1152]))[0]
    images = media.read_images(stored)[1]
    assert len(images) == 2 and b"".join(i.thumbnail.tobytes() for i in images) == data.tobytes()


def test_feature_of_many_images():
    """What comes after the first image counts: other samples there, or more of them."""
    first = np.random.default_rng(1).integers(0, 256, 576 * 8191, dtype=np.uint8)
    tails = [np.full(576 * 4000, 0, np.uint8), np.full(576 * 4000, 255, np.uint8), np.full(576 * 5000, 255, np.uint8), np.zeros(0, np.uint8)]
    payloads = [np.concatenate((first, t)) for t in tails]
    images = media.read_images(media.write_payloads(np.concatenate(payloads), np.array([len(p) for p in payloads])))
    assert [len(x) for x in images] == [2, 2, 2, 1]
    got = [media.feature(x) for x in images]
    assert len(set(got)) == 4 and got[3] == f"{images[3][0].width}x{images[3][0].height}:{media.thumbnail_hash(images[3][0].thumbnail)}"
    assert got[0] == f"{576 * 8}x{(8191 + 4000) * 8}:{media.thumbnail_hash(payloads[0].reshape(-1, 576))}"


def _bits(out, code, n):
    out.extend((code >> (n - 1 - i)) & 1 for i in range(n))


def _jpeg_with_ac(blocks, comps, size, sampling, restart=0):
    """A small writer with AC coefficients and several components, to read what the payload writer never makes."""
    dc = {s: (c, n) for s, c, n in media.huffman_codes(media.DC_LENGTHS, media.DC_SYMBOLS)}
    symbols = (0x00, 0xF0, 0x11, 0x22, 0x53)
    lengths = (0, 1, 1, 1, 2) + (0,) * 11
    ac = {s: (c, n) for s, c, n in media.huffman_codes(lengths, symbols)}
    parts, out, last, k = [], [], defaultdict(int), 0
    for i, (comp, level, extra) in enumerate(blocks):
        d = level - last[comp]
        last[comp] = level
        n = abs(d).bit_length()
        _bits(out, *dc[n])
        if n:
            _bits(out, d if d > 0 else d + (1 << n) - 1, n)
        for s, v in extra:
            _bits(out, *ac[s])
            if s & 15:
                _bits(out, v, s & 15)
        _bits(out, *ac[0])
        if restart and (i + 1) % (restart * sum(h * v for h, v in sampling)) == 0 and i + 1 < len(blocks):
            parts.append((out, k))
            out, k = [], k + 1
            last.clear()
    parts.append((out, None))
    body = b""
    for bits, k in parts:
        bits += [1] * (-len(bits) % 8)
        body += np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") + (b"" if k is None else bytes([0xFF, 0xD0 + k % 8]))
    seg = media._segment
    head = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\x00" + bytes([16] + [3] * 63)) + seg(0xC0, bytes([8]) + size[1].to_bytes(2, "big") + size[0].to_bytes(2, "big") + bytes([comps]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    head += seg(0xC4, b"\x00" + bytes(media.DC_LENGTHS) + bytes(media.DC_SYMBOLS)) + seg(0xC4, b"\x10" + bytes(lengths) + bytes(symbols))
    if restart:
        head += seg(0xDD, restart.to_bytes(2, "big"))
    return head + seg(0xDA, bytes([comps]) + b"".join(bytes([i + 1, 0]) for i in range(comps)) + b"\x00\x3f\x00") + body + b"\xff\xd9"


def test_colour_image_with_ac_and_sampling():
    rng = np.random.default_rng(5)
    levels = rng.integers(-60, 60, (4, 6))  # luminance blocks of 2x2 units, 2 rows of 3
    blocks = []
    for y in range(2):
        for x in range(3):
            blocks += [(0, int(levels[2 * y + j, 2 * x + i]), [(0x11, 1), (0xF0, 0), (0x53, 5)] if i else []) for j in range(2) for i in range(2)]
            blocks += [(1, 5, []), (2, -7, [(0x22, 2)])]
    for restart in (0, 2):
        image = media.read_images([_jpeg_with_ac(blocks, 3, (45, 30), [(2, 2), (1, 1), (1, 1)], restart)])[0][0]
        assert (image.width, image.height, image.components) == (45, 30, 3)
        assert np.array_equal(image.thumbnail, np.clip((levels * 16 + 4 >> 3) + 128, 0, 255))


def test_bad_media(spark):
    good = media.write_payloads(np.zeros(576, np.uint8), np.array([576]))[0]
    rows = [(1, None), (2, b""), (3, b"no image"), (4, good[:60]), (5, good[:-60]), (6, good.replace(b"\xff\xc0", b"\xff\xc2")), (7, good)]
    got = {r["id"]: r for r in collect(media.jpeg_columns(spark.createDataFrame(rows, "doc_id long, media binary")))}
    assert [got[i]["error"] is None for i in range(1, 8)] == [False] * 6 + [True]
    assert (got[7]["width"], got[7]["height"]) == (192, 192)


# --- 3 language-model scoring --------------------------------------------------------------------------------

def words(t):
    return re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode()))


def test_mixing_counts(spark, mixed, hard):
    docs = mixed.union(hard.select(*mixed.columns))
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    rows = docs.select("doc_id", "text", train.alias("train")).collect()
    c = Counter(x for r in rows if r["train"] for x in [*words(r["text"]), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = [*words(r["text"]), None]
        want[r["doc_id"], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)] += 1
    got = collect(context_mixing.mixing_scores(docs.withColumn("train", train)))
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_spelling_is_a_distribution():
    """The probabilities of the next byte add up to one, after any beginning."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (context_mixing.SLOTS, 2)).astype(np.float32)
    m = context_mixing.Mixer(counts[:, 0], counts[:, 1])
    m.weights = rng.normal(size=m.weights.shape).astype(np.float32)
    for before in (b"", b"ab"):
        size = np.array([len(before) + (b != 32) for b in range(256)])
        blob = b"".join(before + (bytes([b]) if b != 32 else b"") for b in range(256))
        total = 0.0
        spelled = context_mixing.Spelling(np.frombuffer(blob, np.uint8), size)
        for live, c, bases, j in spelled.steps():
            if j == len(before):
                p = np.ones(len(live))
                for node, bit, b in context_mixing.bit_nodes(c):
                    x, g = m.look([q + node for q in bases], b)
                    one = m.probability(x, g, node)[1]
                    p *= np.where(bit == 1, one, 1 - one)
                total = p.sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_adapt_alone_and_together():
    rng = np.random.default_rng(3)
    n = np.array([40, 3, 0, 25, 1, 60, 2, 9, 30])
    k = int(n.sum())
    args = (n, rng.uniform(5, 2000, k), [rng.uniform(0, 0.1, k) for _ in range(3)], context_mixing.START)
    few, context_mixing.FEW = context_mixing.FEW, -1
    try:
        slow = context_mixing.adapt(*args)
    finally:
        context_mixing.FEW = few
    assert np.allclose(slow, context_mixing.adapt(*args))


def small_scorer(seed: int = 4, n: int = 400):
    """A scorer of random counts, and how many words it knows."""
    rng = np.random.default_rng(seed)
    every = np.sort((rng.pareto(0.8, n) * 2 + 1).astype(np.int64))
    of = text_mixing.class_of_count(every)
    code = text_mixing.Code(np.bincount(of, minlength=text_mixing.CLASSES), np.bincount(of, every, text_mixing.CLASSES).astype(np.int64), 50)
    number = context_mixing.numbers_of(code, every, np.zeros(text_mixing.CLASSES, np.int64))
    assert sorted(number.tolist()) == list(range(2, n + 2))
    counts = np.zeros((code.groups, 3), np.int64)
    np.add.at(counts, code.group_of(number), rng.integers(0, 5, (n, 3)))
    tables = context_mixing.pack_counts(*code.tables(np.column_stack((counts.sum(axis=1), counts))))
    pairs = rng.integers(0, 5, (code.pair_slots + 1 + text_mixing.AGAIN, 2))
    pairs[code.pair_slots] = 0
    return text_mixing.Scorer(code, tables, context_mixing.pack_counts(pairs[:, 0], pairs[:, 1]), context_mixing._COUNTS), n + 2


def test_next_words_are_a_distribution():
    """The probabilities of all words that may come next add up to one, whatever stands before."""
    scorer, n = small_scorer()
    assert (scorer.code.words > 1).any()
    rng = np.random.default_rng(6)
    for size in (0, 1, 5, 70, 300):
        before = rng.integers(2, n, size)
        rows = np.column_stack((np.tile(before, (n, 1)), np.arange(n))).ravel()
        whole = scorer.score(rows, np.full(n, size + 1), 1)
        first = scorer.score(before, np.array([size]), 1)[0] if size else 0.0
        assert np.sum(10 ** (whole - first)) == pytest.approx(1, abs=1e-4)


def test_numbers_move_small():
    rng = np.random.default_rng(3)
    for most in (3, 200, 60_000, 1 << 20, 1 << 40):
        x = np.cumsum(rng.integers(0, most, 500))
        assert np.array_equal(context_mixing._ascending(context_mixing._gaps(x)), x)
        n = rng.integers(0, most, (500, 2))
        assert np.array_equal(context_mixing._ints(context_mixing._short(n), n.size).reshape(n.shape), n)
    assert not len(context_mixing._ascending(context_mixing._gaps(np.zeros(0, np.int64)))) and not len(context_mixing._ints(context_mixing._short(np.zeros(0, np.int64)), 0))
    assert len(context_mixing._gaps(np.arange(0, 100_000, 100))) == 1001


def test_costs_look_at_a_byte_at_once(monkeypatch):
    """One look at the tables for each place of a word, whatever its bits; the bits' nodes are those one by one."""
    c = np.arange(256, dtype=np.uint8)
    node, bit, b = (x.reshape(8, -1) for x in context_mixing.byte_nodes(c))
    for i, (x, y, k) in enumerate(context_mixing.bit_nodes(c)):
        assert np.array_equal(node[i], x) and np.array_equal(bit[i], y) and (b[i] == k).all()
    looks = []
    m = context_mixing.Mixer(np.zeros(context_mixing.SLOTS), np.zeros(context_mixing.SLOTS))
    look = m.look
    monkeypatch.setattr(m, "look", lambda *a: looks.append(1) or look(*a))
    m.costs(np.frombuffer(b"abcde", np.uint8), np.array([5]))
    assert len(looks) == 6


def test_documents_score_alike_alone_and_together(monkeypatch):
    """In slices, in windows, and with others."""
    scorer, n = small_scorer()
    rng = np.random.default_rng(8)
    size = np.array([3, 1, 2500, 40, 700, 3, 1, 90])
    number = rng.integers(0, n, int(size.sum()))
    number[-90:] = 2 + np.arange(90) % 7
    want = scorer.score(number, size, 2)
    ends = np.cumsum(size)
    assert np.array_equal(want[:3], scorer.score(number[: ends[2]], size[:3], 2))
    monkeypatch.setattr(text_mixing, "WINDOW", 512)
    monkeypatch.setattr(text_mixing, "slices", lambda size: ([i] for i in range(len(size))))
    alone = scorer.score(number, size, 2)
    assert np.allclose(want, alone, rtol=1e-5)


def test_score_sees_the_words_before(spark):
    """Words that follow each other in training are likelier in that order; the same words in another order are not."""
    rng = random.Random(5)
    chain = [f"{a}{b}n" for a in "bcdfgklm" for b in "aeiou"]
    follow = {w: chain[(7 * i + 3) % len(chain)] for i, w in enumerate(chain)}

    def text(n):
        out = [rng.choice(chain)]
        while len(out) < n:
            out.append(follow[out[-1]] if rng.random() < 0.9 else rng.choice(chain))
        return out

    held = [text(40) for _ in range(20)]
    rows = [(i, " ".join(text(60)), True) for i in range(200)]
    rows += [(1000 + i, " ".join(t), False) for i, t in enumerate(held)] + [(2000 + i, " ".join(rng.sample(t, len(t))), False) for i, t in enumerate(held)]
    got = {r["doc_id"]: r["score"] for r in collect(context_mixing.mixing_scores(spark.createDataFrame(rows, "doc_id long, text string, train boolean")))}
    ordered, other = sum(got[1000 + i] for i in range(20)), sum(got[2000 + i] for i in range(20))
    assert ordered > 0.75 * other
    base = 20 * 40 * math.log10(1 / len(chain))
    assert ordered > 0.8 * base


def test_tables_follow_the_vocabulary():
    """Slots grow with the contexts that sketches count, and few of what falls in is met by others."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (2_000, 60_000):
        size = rng.integers(3, 12, n)
        blob = rng.integers(97, 123, int(size.sum())).astype(np.uint8)
        sketch = np.zeros((len(context_mixing.ORDERS), 1 << context_mixing.SKETCH_BITS), np.uint8)
        context_mixing.sketch_pairs(blob, size, sketch)
        blocks = context_mixing.table_blocks([context_mixing.sketched(x) for x in sketch])
        spelled = context_mixing.Spelling(blob, size)
        for i, order in enumerate(context_mixing.ORDERS):
            pairs = {(order == 1 or int(h), int(x)) for _, c, seen, _ in spelled.contexts() for h, x in zip(seen[i], c, strict=True)} if n < 5_000 else None
            if pairs and order > 1:
                assert context_mixing.sketched(sketch[i]) == pytest.approx(len(pairs), rel=0.1)
        keys, w = context_mixing.count_pairs(blob, size, np.ones(n), blocks)
        assert w.sum() == (size + 1).sum() * len(blocks) and keys.max() < 256 * sum(blocks) * context_mixing.RANGE
        shares.append(sum(blocks))
    assert shares[1] > shares[0] >= sum(context_mixing.BLOCKS)


def test_mixer_learns_from_all_words():
    """Words of any length, every one of their bits."""
    words_ = [b"ab", b"", b"x" * 200, b"q" * 65]
    size = np.array([len(x) for x in words_])
    m = context_mixing.Mixer(np.zeros(context_mixing.SLOTS), np.zeros(context_mixing.SLOTS))
    before = m.weights.copy()
    met, cells = m.train(np.frombuffer(b"".join(words_), np.uint8), size)
    assert met.sum() == 8 * (size + 1).sum() and cells.sum() == pytest.approx(met.sum()) and not np.array_equal(before, m.weights)


def test_kinds_come_from_all_documents(spark):
    """Texts too long for the sample of first centres, too."""
    rows = [(i, ("abc " if i % 2 else "xyz ") * 6_000, True) for i in range(6)]
    centres = context_mixing.find_kinds(spark.createDataFrame([(9, "mno " * 100, True), *rows], "doc_id long, text string, train boolean"))
    own = context_mixing.pair_profiles(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([0, 24_000]))
    assert float((own @ centres.T).max()) > 0.5


def test_mixing_empty(spark, empty):
    assert context_mixing.mixing_scores(empty.withColumn("train", F.lit(True))).count() == 0


# --- 4 n-gram Jaccard join -------------------------------------------------------------------------------------

def jaccard_truth(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(s), d if not s else min(least[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("shard", [1500, 3])
def test_jaccard_groups(spark, mixed, hard, shard, monkeypatch):
    monkeypatch.setattr(jaccard, "SHARD", shard)
    docs = mixed.union(hard.select(*mixed.columns))
    got = collect(jaccard.jaccard_groups(docs))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == jaccard_truth([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_many_small_components_of_one_key(spark, monkeypatch):
    """Sets that share some of their rarest words, but link with few others, are dealt to many shards and still found."""
    monkeypatch.setattr(jaccard, "SHARD", 4)
    common = prose(41, 12)
    rows = []
    for i in range(40):
        t = f"{common} {prose(500 + i, 45, 10_000)}"
        rows += [(2 * i, t), (2 * i + 1, " ".join([*t.split()[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, jaccard.jaccard_groups(docs).collect())) == sorted(jaccard_truth(rows))


def test_jaccard_keeps_every_row_of_equal_chunks(spark):
    """Chunks of the same text, of which two have the same id and one has another."""
    rows = [(7, prose(3, 40)), (7, prose(3, 40)), (9, prose(3, 40))]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in collect(jaccard.jaccard_groups(df))) == [(7, 7), (7, 7), (9, 7)]


def test_jaccard_empty(spark, empty):
    assert jaccard.jaccard_groups(empty).count() == 0


def test_divide_skip_is_exhaustive():
    rng = np.random.default_rng(4)
    pool = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(80)]
    pool += [np.unique(np.append(p, rng.integers(0, 60, 2))) for p in pool[:40]]
    lists = jaccard.Lists(pool, np.array([len(p) for p in pool]))
    for p in pool:
        want = {i for i, q in enumerate(pool) if 100 * len(np.intersect1d(p, q)) >= 80 * len(np.union1d(p, q))}
        assert set(lists.search(p, len(p)).tolist()) == want


def test_components_of_a_long_chain(spark):
    pairs = [(f"{i:03d}", f"{i + 1:03d}") for i in range(0, 90)] + [("900", "901"), ("900", "900")]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(pairs, "a string, b string"), Scratch(spark, "test")).collect())
    assert got["090"] == "000" and got["901"] == "900" and len(got) == 93


# --- 5 quality, 9 language ----------------------------------------------------------------------------------------

def test_quality_held_out(spark, tiny):
    d = tiny.replace("sf0.001", "sf0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = quality.quality_scores(spark, docs, labels).join(labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1), "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.98


def test_quality_hard(spark, hard, empty, labels):
    got = collect(quality.quality_scores(spark, hard, labels))
    assert len(got) == hard.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality_scores(spark, empty, labels).count() == 0
    assert {r["score"] for r in collect(quality.quality_scores(spark, hard, labels.limit(0)))} == {0.5}


def statistics_truth(text: str) -> list[float]:
    """The statistics by the letter, in Python."""
    b = text.encode()
    n, odds = len(b), lambda k, whole: math.log((k + 0.5) / (max(whole - k, 0) + 0.5))
    found = [w for w in re.split(rb"[\t-\r ]+", b.translate(bytes(common._LOWER.tolist()))) if w]
    length = [len(w) for w in found]
    mean = sum(length) / max(len(found), 1)
    spread = math.sqrt(max(sum(x * x for x in length) / max(len(found), 1) - mean**2, 0))
    stops, blank = b"!,.:;?", b"\t\n\x0b\x0c\r "
    marks = [c for c in b if c not in stops and c not in blank and not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128)]
    count = lambda own: sum(c in own for c in b)
    digits, capitals = sum(48 <= c < 58 for c in b), sum(65 <= c < 91 for c in b)
    letters = sum(65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in b)
    lines = re.findall(rb"[^\n]*\n|[^\n]+\Z", b)
    shares = [k / n for k in Counter(b).values()]
    many = len(found)
    return [
        math.log1p(n), math.log1p(many), math.log1p(mean), math.log1p(spread), odds(letters, n), odds(digits, n), odds(len(marks), n), odds(count(stops), n), odds(count(blank), n), odds(capitals, n),
        odds(len(set(found)), many), math.log1p(len(lines)), odds(len(lines) - len(set(lines)), len(lines)), -sum(p * math.log2(p) for p in shares), odds(sum(x <= 3 for x in length), many), odds(sum(x >= 12 for x in length), many),
        odds(sum(x == 1 for x in length), many), odds(sum(any(c in marks for c in w) for w in found), many),
    ]


def test_statistics_by_the_letter(hard):
    some = ["", " ", "\n\n", "One two, THREE.\nOne two, THREE.\n12 a-b $5 naïve\t\x0bend", "x" * 90, "a\n" * 40 + "b", prose(5, 400) + "\n" + prose(6, 100).upper() + "!? #1\n"] + [r["text"] or "" for r in hard.select("text").collect()]
    data = [t.encode() for t in some]
    at = np.concatenate(([0], np.cumsum([len(b) for b in data])))
    got = quality.statistics(np.frombuffer(b"".join(data), np.uint8), at)
    for t, b, row in zip(some, data, got, strict=True):
        assert np.allclose(row, statistics_truth(t)), t[:40]
        for part in (7, 64, 1000) if len(b) < 3000 else (1000, 9999):
            assert np.allclose(quality.long_statistics(np.frombuffer(b, np.uint8), part)[0], row), (t[:40], part)


def test_discriminant_keeps_digits(spark):
    """Far from zero, where a sum of squares less the squared mean would lose them."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, len(quality.FEATURES))) * 1e-3 + 1e6
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "label int, stats array<double>").repartition(3)
    m = quality.fit(rows)
    one = x[::2]
    want = np.cov(one.T, bias=True)
    scatter = np.cov(x[1::2].T, bias=True)
    c = 0.9 * want + 0.1 * (want + scatter) / 2
    c = 0.98 * c + 0.02 * (np.trace(c) / len(c) + 1e-9) * np.eye(len(c))
    assert np.allclose(np.linalg.inv(m.factors[0]) @ np.linalg.inv(m.factors[0]).T, c, rtol=1e-4, atol=1e-12)


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(6)
    x = [rng.normal(size=(400, 3)), rng.normal(size=(300, 3)) * [1, 2, 0.5] + 1]
    m = quality.Discriminant(np.array([400.0, 300.0]), np.array([a.sum(axis=0) for a in x]), np.array([(a - a.mean(axis=0)).T @ (a - a.mean(axis=0)) for a in x]), 0, 0)
    p = []
    for a, prior in zip(x, m.priors, strict=True):
        c = np.cov(a.T, bias=True)
        d = x[0][:5] - a.mean(axis=0)
        p.append(prior * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)) / np.sqrt(np.linalg.det(c)))
    assert np.allclose(m.scores(x[0][:5]), p[1] / (p[0] + p[1]))


def test_language_held_out(spark, tiny):
    d = tiny.replace("sf0.001", "sf0.01")
    docs = table(spark, d, "documents")
    model = language.fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    assert language.languages(held, model).join(held, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


def test_language_hard(spark, hard, empty):
    model = language.fit(hard.where("lang IS NOT NULL AND text IS NOT NULL"))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in collect(language.languages(hard, model))}
    assert (1, "und", 0.0) in got and (2, "und", 0.0) in got and (9, "und", 0.0) in got
    assert language.languages(hard, language.fit(empty)).where("lang_pred <> 'und'").count() == 0


def test_grams_by_the_letter_and_in_pieces(monkeypatch):
    some = ["", "a", "Ab cd", "1 x", " lead\n\ntrail! ", "naïve façade – 日本語 😀 \x00 end", "..,,", prose(3, 40)]
    keys, row, letters = language.grams(some)
    for i, t in enumerate(some):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in f"\n{t}\n")
        low = re.sub("\0+", "\0", low)
        want = Counter(low[k : k + n] for n in language.SIZES for k in range(len(low) - n + 1) if low[k : k + n].count("\0") <= 1)
        own = keys[row == i]
        assert len(own) == want.total() and sorted(Counter(own.tolist()).values()) == sorted(want.values()) and letters[i] == sum(c.isalpha() for c in t)
        for size in (1, 2, 5, 1000):
            parts = list(language.long_grams(t, size))
            assert sum(n for _, n in parts) == letters[i]
            assert not t or np.array_equal(np.sort(np.concatenate([k for k, _ in parts])), np.sort(own)), (t, size)
    f = language.Filter(["a", "b"], 1 << 12)
    f.add(0, keys[row == 7])
    f.settle()
    before = f.decide([some[7]])
    monkeypatch.setattr(language, "CHUNK_CHARS", 30)
    assert f.decide([some[7]])[0] == before[0] and np.allclose(f.decide([some[7]])[1], before[1])


def test_grams_of_long_texts_count_alike(spark, monkeypatch):
    docs = spark.createDataFrame([("en", prose(1, 900)), ("en", "x" * 300 + " " + "yz" * 200), ("fr", None), ("fr", "né " * 90)], "lang string, text string")
    want = sorted(map(tuple, language.gram_counts(docs).collect()))
    monkeypatch.setattr(language, "CHUNK_CHARS", 60)
    monkeypatch.setattr(language, "text_pieces", lambda t, b: common.text_pieces(t, b, 50))
    assert sorted(map(tuple, language.gram_counts(docs).collect())) == want and want


def test_filter_has_no_false_negatives():
    for many, one in ((2, 1), (130, 129)):
        f = language.Filter([f"l{i}" for i in range(many)], 1 << 12)
        keys = np.arange(100, dtype=np.uint64) * np.uint64(977)
        f.add(one, keys)
        assert f.holds(f.masks_of(keys), one).all() and not f.holds(f.masks_of(keys), 0).any()
        f.settle()
        assert f.false[0] == 0 and 0 < f.false[one] < 0.01


# --- 6 token counts, 10 packing -------------------------------------------------------------------------------------

def test_token_counts_as_the_library(spark, tiny, hard):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = table(spark, tiny, "documents").select("doc_id", "text").union(hard.select("doc_id", "text")).union(spark.createDataFrame([(50, "<s> </s>▁x  y\n\n z <0x0A>"), (51, " lead"), (52, "   ")], "doc_id long, text string"))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(sp.encode(r["text"] or "")), len(sp.encode(r["text"] or "")) > 4096) for r in docs.collect())
    assert Counter(tuple(r.values()) for r in collect(token_counts.token_counts(docs, path))) == want


def test_token_counts_in_stretches(monkeypatch):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    m, sp = token_counts.machine(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    parts = [" ", "  ", "▁", "\n", "a", "the", "ing", "日", "é", "😀", "1", "23", ".", "<s>", "\t", "qu", "ick", "x" * 80]
    some = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(600)] + [" ".join("word" + "y" * (i % 90) for i in range(200))]
    data = [t.encode() for t in some]
    got = m.count_rows(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in data]))))
    assert got.tolist() == [len(sp.encode(t)) for t in some]
    monkeypatch.setattr(token_counts, "SLICE", 20)
    for t in some[-200:]:
        assert m.tokens(t) == len(sp.encode(t)), t


def test_another_model_is_refused(monkeypatch):
    """A model whose counts the machine does not reproduce is an error, not a miscount."""
    monkeypatch.setattr(token_counts.Transducer, "weight", lambda self, piece: 2)
    with pytest.raises(ValueError, match="normalisation"):
        token_counts.Transducer(P.path("piece_bpe_32k.model"))


def test_chunks_compose():
    m = token_counts.machine(P.path("piece_bpe_32k.model"))
    text = "▁the▁▁▁▁quick▁brown▁foxes日本jumped" * 7
    whole = m.run(0, text)[1]
    for k in (1, 3, 10, 50):
        assert m.scan([text[i : i + k] for i in range(0, len(text), k)]) == whole


def test_packing(spark, tiny, hard):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = table(spark, tiny, "documents").select("doc_id", "text").union(hard.select("doc_id", "text")).union(spark.createDataFrame([(60, "a <|endoftext|> b")], "doc_id long, text string"))
    got = collect(packing.best_fit_packing(spark, docs, path, with_ids=True))
    want = Counter((r["doc_id"], tuple([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in docs.collect())
    firsts = [r for r in got if r["piece"] == 0]
    assert len(firsts) == sum(want.values())
    seats = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        seats[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seats.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 1024
    by = defaultdict(dict)
    for r in got:
        by[r["doc_id"]].setdefault(r["piece"], []).append(r)
    for (doc, ids), n in want.items():
        if doc is not None and sum(k for (d, _), k in want.items() if d == doc) == n:
            assert sum((tuple(by[doc][p][0]["ids"]) for p in sorted(by[doc])), ()) == ids and all(len(by[doc][p]) == n for p in by[doc])
    total = sum(r["length"] for r in got)
    assert len(seats) <= -(-total // 1024) * 1.05 + 1


def test_shuffled_counts_give_the_same(spark, tiny, monkeypatch):
    path, docs = P.path("byte_bpe_50k.json"), table(spark, tiny, "documents").repartition(5, "doc_id")
    a = Counter(map(tuple, packing.best_fit_packing(spark, docs, path).collect()))
    monkeypatch.setattr(packing, "BROADCAST_BYTES", -1)
    assert Counter(map(tuple, packing.best_fit_packing(spark, docs, path).collect())) == a


def test_plan_is_best_fit_decreasing():
    """As many sequences as best fit piece by piece, every rank in one slot, offsets gapless."""
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([10, 64, 100, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 60))}
        rooms, most = [], 0
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                i = bisect.bisect_left(rooms, n)
                room = rooms.pop(i) if i < len(rooms) else capacity
                most += room == capacity
                if room > n:
                    bisect.insort(rooms, room - n)
        seats, ranks = defaultdict(list), defaultdict(list)
        for n, rank, slots, copies, first, offset in packing.plan(counts, capacity):
            ranks[n].append((rank, slots))
            for j in range(slots):
                seats[first + j // copies].append((offset + j % copies * n, n))
        for n, r in ranks.items():
            r.sort()
            assert [a for a, _ in r] == np.cumsum([0, *(k for _, k in r)])[:-1].tolist() and sum(k for _, k in r) == counts[n]
        for s in seats.values():
            s.sort()
            assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= capacity
        assert len(seats) == most


def test_packing_empty(spark, empty):
    assert packing.best_fit_packing(spark, empty, P.path("byte_bpe_50k.json")).count() == 0


# --- 7 suffix-array dedup ---------------------------------------------------------------------------------------------

def repeats_truth(rows):
    count = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    out = Counter()
    for d, t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        g = np.cumsum(gone)[:-1] > 0
        spans = int((g & ~np.concatenate(([False], g[:-1]))).sum()) if len(t) else 0
        out[d, len(t), int(g.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~g])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot,batch,many", [(20_000, 8192, 1 << 12), (0, 8192, 1 << 12), (20_000, 5, 2)])
def test_repeats(spark, mixed, hard, hot, batch, many, monkeypatch):
    """In one batch, by counted fingerprints, and over many levels with fingerprints in the family."""
    for name, value in (("HOT", hot), ("BATCH", batch), ("MANY", many)):
        monkeypatch.setattr(repeats, name, value)
    docs = mixed.union(hard.where("doc_id <> 6 OR doc_id IS NULL").select(*mixed.columns))
    out = repeats.without_repeats(docs).withColumn("sha", F.sha2("kept", 256))
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in collect(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "sha")))
    assert got == repeats_truth([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()])


def test_long_texts_in_stretches(monkeypatch):
    """Every string chooses the same anchor, whether a text is taken whole or in stretches."""
    rng = np.random.default_rng(8)
    data = rng.integers(97, 123, 5000, dtype=np.uint8)
    data[3000:3900] = data[100:1000]
    at = np.array([0, len(data)])
    spread = lambda a: {(i, int(p), int(k)) for _, p, s, e, k in zip(*a, strict=True) for i in range(s, e + 1)}
    whole = spread(repeats.anchors(data, at))
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    assert spread(repeats.anchors(data, at)) == whole and len(whole) == 4801


def test_spans_hash_alike_in_pieces():
    data = np.random.default_rng(9).integers(0, 256, 3000, dtype=np.uint8)
    start = np.arange(0, 2900, 7)
    assert np.array_equal(common.hashed_spans(data, start, start + 20, 100), common.hashed_spans(data, start, start + 20))


def test_hashing_a_chunk_takes_little_memory(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)})
    data = np.random.default_rng(4).integers(97, 123, common.CHUNK_BYTES).astype(np.uint8)
    start = np.arange(0, len(data), 8)
    tracemalloc.start()
    common.hashed_spans(data, start, start + 7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 << 20



def test_levels_are_geometric():
    f = repeats.Family()
    rng = np.random.default_rng(7)
    for _ in range(20):
        f.add([(rng.integers(0, 256, 260, dtype=np.uint8).tobytes(), 40) for _ in range(10)])
    assert sum(map(len, f.levels)) == 200 and len(f.levels) <= 8
    assert all((np.diff(np.unique(f._suffixes(x), return_inverse=True)[1]) >= 0).all() for x in f.levels)


def test_repeats_empty(spark, empty, hard):
    assert repeats.without_repeats(empty).count() == 0
    assert repeats.without_repeats(hard).columns[: len(hard.columns) - 1] == [c for c in hard.columns if c != "text"]
    assert repeats.without_repeats(hard.select("text")).columns == ["n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_text"]


# --- 8 decontamination ------------------------------------------------------------------------------------------------

def overlap_truth(docs, items):
    """All places of all items against all texts, without seeds."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for item, t in items:
        b = split(t)
        if not b:
            continue
        width = min(len(b), decontamination.WINDOW)
        least = len(b) if len(b) < decontamination.LEAST_WORDS else math.ceil(decontamination.SAME * width)
        for doc, x in docs:
            w = split(x)
            for shift in range(-len(b), len(w)):
                low, high = max(0, -shift), min(len(b), len(w) - shift)
                if high - low < width:
                    continue
                same = [w[i + shift] == b[i] for i in range(low, high)]
                n = max(sum(same[i : i + width]) for i in range(len(same) - width + 1))
                if n >= least:
                    best = out.get((doc, item))
                    if best is None or (n, -shift) > (best[0], -best[2]):
                        out[doc, item] = (n, width, shift)
    return out


def test_overlaps(spark, hard):
    item = prose(7, 40)
    w = item.split()
    swapped = [x if i % 8 else "other" for i, x in enumerate(w)]
    docs = [(1, prose(8, 50) + " " + item + " " + prose(9, 20)), (2, "before " + " ".join(swapped) + " after"), (3, prose(10, 200)), (4, " ".join(w[:13])), (5, item.upper() + "!"), (6, None), (7, " ".join(x if i % 2 else "no" for i, x in enumerate(w)))]
    items = [(1, item), (2, "too short"), (3, None), (4, prose(11, 30)), (1, item)]
    got = {(r["doc_id"], r["item_id"]): (r["n_same"], r["n_window"], r["start"]) for r in collect(decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))}
    assert got == overlap_truth(docs, items) and {d for d, _ in got} == {1, 2, 4, 5}
    kept = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {3, 6, 7}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.decontaminate(hard, bench).columns == hard.select("doc_id", *[c for c in hard.columns if c != "doc_id"]).columns
    assert decontamination.overlaps(hard.limit(0), bench).count() == 0 and decontamination.overlaps(hard, bench.limit(0)).count() == 0


def test_overlaps_of_short_items(spark):
    """Against brute force that knows no seeds: every substitution of as many words as may differ, and one more."""
    rng, docs, items, want = random.Random(4), [], [], set()
    for m in (1, 2, 5, 7, 8, 9, 10, 11, 12, 13):
        w = [f"w{m}x{i}" for i in range(m)]
        items.append((m, " ".join(w)))
        may = 0 if m < 8 else m - math.ceil(0.8 * m)
        for k in range(may + 2):
            for gone in combinations(range(m), k):
                doc = len(docs)
                docs.append((doc, " ".join([f"a{rng.random()}", *("other" if i in gone else x for i, x in enumerate(w)), "z"])))
                if k <= may:
                    want.add((doc, m, m - k, m))
    got = collect(decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {(r["doc_id"], r["item_id"], r["n_same"], r["n_window"]) for r in got} == want


def test_overlaps_across_stretches(spark, monkeypatch):
    """Items at every place of texts of several stretches, broadcast and shuffled."""
    monkeypatch.setattr(decontamination, "STRETCH", 20)
    items = [(1, prose(21, 15)), (2, prose(22, 13)), (3, prose(23, 9)), (4, "q1 q2")]
    fill = prose(24, 90, 100_000).split()
    docs = [(i, " ".join([*fill[:i], *t.split(), *fill[i : i + 30]])) for i in range(0, 60, 3) for _, t in items] + [(100, prose(25, 13))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 26, -1):
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", limit)
        got = {(r["doc_id"], r["item_id"]): (r["n_same"], r["n_window"], r["start"]) for r in collect(decontamination.overlaps(*frames))}
        assert got == overlap_truth(docs, items) and len(got) == 80


def test_shuffled_seeds_give_the_same(spark, tiny, monkeypatch):
    docs, bench = table(spark, tiny, "documents"), table(spark, tiny, "benchmark")
    a = sorted(map(tuple, decontamination.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, decontamination.overlaps(docs, bench).collect())) == a and a


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, tiny, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    got = registry.QUERIES[name](spark, tiny)
    cols = sorted(got.columns)
    want = sorted(c.execute(f"select {', '.join(cols)} from ({registry.ORACLE_SQL[name]})").fetchall())
    assert sorted(map(tuple, got.select(*cols).collect())) == want


# --- the pipeline -----------------------------------------------------------------------------------------------------

def test_pipeline(spark, tiny):
    import corpus_pipeline

    docs = table(spark, tiny, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], tiny)
        if name != "best-fit packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
            out = out.cache()
        steps.append(out)
    start, good, single, cut, clean, packed = steps
    ids = lambda x: {r[0] for r in x.select("doc_id").collect()}
    scores = {r["doc_id"]: r["score"] for r in collect(quality.quality_scores(spark, start, table(spark, tiny, "labels")))}
    assert ids(good) == {d for d, s in scores.items() if s >= 0.5}
    truth = jaccard_truth([(r["doc_id"], r["text"]) for r in good.select("doc_id", "text").collect()])
    assert ids(single) == {d for d, _, c in truth if c == d}
    assert ids(cut) == ids(single)
    spans = repeats_truth([(r["doc_id"], (r["text"] or "").encode()) for r in single.select("doc_id", "text").collect()])
    touched = {d for d, _, gone, _, _ in spans if gone}
    before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in (single, cut))
    assert {d for d in before if before[d] != after[d]} == touched
    assert ids(clean) == ids(cut) - {r["doc_id"] for r in decontamination.overlaps(cut, table(spark, tiny, "benchmark")).collect()}
    assert {r[0] for r in packed.select("doc_id").collect()} == ids(clean)
    assert corpus_pipeline.run(spark, tiny).count() == packed.count()


def test_pipeline_on_hard_rows(spark, hard, empty, tiny):
    import corpus_pipeline

    docs = hard.select("doc_id", "text", "lang", "source", "n")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(Scratch(spark, "test").keep(stage(spark, kept[-1], tiny)))
    ids = [Counter(r[0] for r in k.select("doc_id").collect()) for k in kept]
    assert all(set(y) <= set(x) for x, y in zip(ids, ids[1:], strict=False)) and ids[1][None] == 2
    assert sum(r["length"] for r in collect(kept[-1])) == sum(len(r["ids"]) for r in collect(kept[-1])) and kept[-1].count() == kept[-2].count()
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = Scratch(spark, "test").keep(stage(spark, docs, tiny))
    assert docs.count() == 0


def test_one_of_each_group_by_row(spark):
    """Rows that repeat an id are judged by their own texts."""
    import corpus_pipeline

    a, b = prose(31, 30), prose(32, 30)
    rows = [(1, a), (1, b), (2, a), (None, a), (3, " "), (3, " "), (4, None), (None, prose(33, 9)), (None, prose(33, 9)), (0, a + " more"), (5, b)]
    got = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    want = [(0, a + " more"), (1, b), (3, " "), (3, " "), (4, None), (None, prose(33, 9))]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_queries_have_contract_columns(spark, tiny):
    want = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op4": "doc_id n_shingles component_id", "op5": "doc_id held_out score predicted", "op6": "doc_id n_bytes n_tokens over_limit", "op7": "doc_id n_bytes n_removed n_spans kept_sha256", "op8": "doc_id item_id",
        "op9": "doc_id held_out lang_pred score", "op10": "doc_id piece start length ids_crc32 sequence_id offset",
    }
    assert {n.split("_")[0] for n in registry.QUERIES} == set(want)
    for name, f in registry.QUERIES.items():
        out = f(spark, tiny)
        assert out.columns[: len(want[name.split("_")[0]].split())] == want[name.split("_")[0]].split()
        if name.split("_")[0] not in ("op8", "op10"):
            assert out.count() == 200
