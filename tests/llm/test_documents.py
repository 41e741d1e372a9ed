"""The document operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import hashlib
import json
import random
import string
import re
import time
import tracemalloc
import zlib
from collections import Counter
from itertools import product
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from levelmap.llm import catalog, lines, mincut, mixture, overlap, packing, quality, simhash, topk, toxicity, urlrules, video
from levelmap.llm.common import thrifty
from levelmap.llm.groups import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, links int, held_out string, block_no int"
LONG = "wörter und mehr, " * 30_000
ODD = [
    (1, "The same words stand here. " * 3, "en", "a", 5, 1, "x", 1),
    (2, "The same words stand here. " * 3, "en", "a", 5, 1, "x", 1),
    (2, "The same words stand here. " * 3, "en", "a", 5, 1, "x", 1),
    (3, None, None, None, None, None, None, None),
    (None, "No id at all", "en", None, 5, 1, "x", 1),
    (4, "", "en", "b", 0, 1, "x", 1),
    (5, " \n\t\n ", "en", "b", 0, 1, "x", 1),
    (6, LONG, "de", "c", len(LONG), 1, "x", 1),
    (7, "<|endoftext|> é 漢字 \U0001f600\x00 end", "en", "c", 5, 1, "x", 1),
]
LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), LABELS)


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _roots(nodes, pairs) -> dict:
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def _varied(rng: random.Random, text: str, most: int, letters: str) -> str:
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.3:
            out.insert(at, rng.choice(letters))
        elif out:
            at = min(at, len(out) - 1)
            out[at : at + 1] = [] if kind < 0.6 else [rng.choice(letters)]
    return "".join(out)


# ---- video -------------------------------------------------------------------------------


def test_video_round_trip(odd):
    got = video.digests(video.store(odd)).collect()
    want = []
    for row in ODD:
        data = (row[1] or "").encode()
        full = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        want.append((row[0] or -1, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert sorted((r.doc_id or -1, *r[1:5]) for r in got) == sorted(want)
    assert len({r[1:] for r in got if r.doc_id in (1, 2)}) == 1


def test_video_random_frames_and_foreign_tables():
    samples = np.random.default_rng(3).integers(0, 256, (40, 24, 24)).astype(np.uint8)
    frames, rate = video.frames_of(video.avi(video.encode_frames(samples)))
    assert rate == video.RATE and (video.decode_frames(frames) == samples).all()
    with pytest.raises(ValueError):
        video.frames_of(b"RIFF....WAVE")


def test_frames_are_coded_in_little_memory():
    samples = np.random.default_rng(1).integers(97, 122, (3600, 24, 24)).astype(np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array([video.avi(video.encode_frames(samples))], pa.binary())], ["media"])
    tracemalloc.start()
    try:
        ((_, _, read, *_),) = video._read(batch, 0)
        assert tracemalloc.get_traced_memory()[1] < 50 << 20
    finally:
        tracemalloc.stop()
    assert (read == samples).all()


def test_shots(spark):
    text = "a" * 576 * 12 + "~" * 576 * 5 + "a" * 576 * 3
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.clip, r.first_frame, r.frames) for r in video.clips(video.store(docs)).collect())
    assert got == [(1, 0, 0, 12), (1, 1, 12, 5), (1, 2, 17, 3), (2, 0, 0, 1)]


def test_video_empty(empty):
    assert video.digests(video.store(empty)).count() == 0


# ---- classifiers -------------------------------------------------------------------------


def _trained(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    docs, labels = [], []
    for i in range(1200):
        text = [rng.choice(words) for _ in range(rng.randint(30, 80))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randint(0, len(text)), rng.choice(["vile", "nasty", "foul"]))
        docs.append((i, "!! ".join(text).upper() if bad else " ".join(text)))
        labels.append((i, int(not bad), int(toxic), "clash"))
    return spark.createDataFrame(docs, "doc_id long, text string"), _labels(spark, labels)


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, operator, label):
    docs, labels = _trained(spark)
    got = operator.scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert len(got) == 1200 and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() > 0.95


@pytest.mark.parametrize(("operator", "bar"), [(quality, 0.5), (toxicity, 0.7)])
def test_classifiers_without_labels_and_odd_rows(spark, odd, empty, operator, bar):
    for labels in (_labels(spark), _labels(spark, [(1, 1, 0, ""), (1, 0, 1, ""), (None, 1, 1, ""), (2, None, None, "")])):
        got = operator.scores(odd, labels).collect()
        assert len(got) == len(ODD) and all(r.score == 0.5 and r.predicted == int(bar <= 0.5) for r in got)
    learning = [(i, i % 2, i % 2, "") for i in range(1, 8)]
    got = operator.scores(odd, _labels(spark, learning)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    assert operator.scores(empty, _labels(spark)).count() == 0


def test_toxicity_counts_all_rows_but_those_for_the_curve(spark, monkeypatch):
    docs, labels = _trained(spark)
    counted, real = [], toxicity.pair_counts
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 20)
    monkeypatch.setattr(toxicity, "pair_counts", lambda learning, subs: counted.append(learning.count()) or real(learning, subs))
    toxicity.fitted(docs, labels)
    learning = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(1200))
    assert learning - 45 <= counted[0] < learning


def _continuations(texts):
    """Distinct words before each word, from the words' own strings."""
    own = [toxicity.WORDS.findall(t.lower()) for t in texts]
    pairs = {(v, w) for words in own for v, w in zip(["", *words[:-1]], words)}
    return Counter(w for _, w in pairs)


def test_toxicity_models_are_normalised_and_smoothed(spark):
    docs, labels = _trained(spark)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("doc_id < 400").collect()
    met = [_continuations([r.text for r in rows if r.toxic == k]) for k in (0, 1)]
    words = sorted(set(met[0]) | set(met[1]))
    table = np.array([[m[w] for w in words] for m in met])
    got = toxicity.log_probabilities(table)
    assert np.allclose(np.exp(got).sum(1), 1)
    both, mass = met[0] + met[1], toxicity.SHARED * min(sum(m.values()) for m in met)
    size = sum(both.values()) + len(both) + 1
    for k in (0, 1):
        total, types = sum(met[k].values()), len(met[k])
        for i, w in enumerate([*words, None]):
            n = met[k][w] if w else 0
            p = (max(n - 0.75, 0) + (0.75 * types + mass) * (both[w] + 1) / size) / (total + mass)
            assert abs(got[k][i] - np.log(p)) < 1e-9
    # A word of neither class tells the classes apart least, and rare words less than frequent ones.
    far = [abs(a - b) for a, b in (toxicity.log_probabilities(np.array([[900, 0, 0], [100, 1, 40]])).T)]
    assert far[1] < far[2] and far[3] < far[2]


def test_toxicity_counts_distinct_contexts(spark):
    docs, labels = _trained(spark)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("doc_id < 300")
    tables = toxicity.pair_counts(rows, 2).groupBy("block", "sub").applyInPandas(toxicity._tables, "block int, sub int, data binary")
    out = np.zeros((2, toxicity.BLOCKS, toxicity.BLOCK), np.int64)
    for r in toxicity.added_blocks(tables).collect():
        out[:, r.block] = toxicity.expanded(bytes(r.data), np.int64).reshape(2, -1)
    out, memo = out.reshape(2, -1), toxicity.WordHashes()
    for k in (0, 1):
        met = _continuations([r.text for r in rows.collect() if r.toxic == k])
        cells = Counter()
        for w, n in met.items():
            cells[int(memo[w] & ((1 << toxicity.WORD_BITS) - 1))] += n
        assert {c: int(n) for c, n in enumerate(out[k].tolist()) if n} == dict(cells)


def _model_of(tables):
    blocks = toxicity.added_blocks(tables).mapInPandas(toxicity._by_bytes, "block int, data binary")
    return toxicity.Model.of([(r.block, bytes(r.data)) for r in blocks.collect()])


def test_toxicity_counts_need_one_worker_a_task(spark):
    docs, labels = _trained(spark)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("doc_id < 120")
    counts = toxicity.counted_blocks(toxicity.pair_counts(rows, 2))
    plan = counts._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    stages = plan.split("Exchange")
    assert [len(re.findall(r"\w+InPandas|MapInArrow", s)) for s in stages] == [1, 1, 1, 0, 0][: len(stages)]
    tables = toxicity.pair_counts(rows, 2).groupBy("block", "sub").applyInPandas(toxicity._counted, "block int, sub int, data binary")
    want = toxicity.added_blocks(tables).mapInPandas(toxicity._by_bytes, "block int, data binary").collect()
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want))


def test_toxicity_pairs_fall_into_parts():
    pairs = np.random.default_rng(3).integers(0, 1 << 38, 5_000).astype(np.uint64)
    for bits, subs in ((toxicity.CONTEXT_BITS, 1), (toxicity.CONTEXT_BITS, 4)):
        parts = dict((where, at.tolist()) for where, at in toxicity._parts(pairs, bits, subs))
        want: dict = {}
        for n, x in enumerate(pairs.tolist()):
            want.setdefault((x >> bits + toxicity.BLOCK_BITS) * subs + x % subs, []).append(n)
        assert parts == want and not [*toxicity._parts(pairs[:0], bits, subs)]


def test_toxicity_batches_are_scored_run_by_run(monkeypatch):
    """A task has the texts of one run as objects, not those of its whole batch."""
    monkeypatch.setattr(toxicity, "CHARS", 10)
    texts = ["four", None, "é" * 9, "", "longer than a run is", "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["doc_id", "text"])
    runs = [*toxicity._runs(batch, 1)]
    assert [t for _, own in runs for t in own] == [t or "" for t in texts]
    assert [i for run, _ in runs for i in run.column(0).to_pylist()] == [*range(6)]
    assert max(len(own) for _, own in runs) == 2 and not [*toxicity._runs(batch.slice(0, 0), 1)]


def test_a_task_gives_its_memory_back():
    """Workers stay for later tasks: what a task has freed must not stay with them."""
    held = lambda: sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
    pins = []

    def each(batches):
        for batch in batches:
            own = [bytearray(50_000) for _ in range(4_000)]
            pins.append(bytearray(50_000))  # lies above them, so that the heap's end can't be cut off
            yield batch
            del own

    batch = pa.RecordBatch.from_arrays([pa.array([1])], ["x"])
    before = held()
    assert [*thrifty(each)([batch])] == [batch] and held() - before < 60


def test_toxicity_pairs_are_discounted_and_interpolated(spark):
    docs, labels = _trained(spark)
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter("doc_id < 120")
    tables = toxicity.pair_counts(rows, 2).groupBy("block", "sub").applyInPandas(toxicity._counted, "block int, sub int, data binary")
    model = _model_of(tables)
    texts, memo = [[], []], toxicity.WordHashes()
    for r in rows.collect():
        own = toxicity.WORDS.findall(r.text.lower())
        texts[r.toxic].append(set(zip([None, *own[:-1]], own)))
    c = [Counter(p for own in texts[k] for p in own) for k in (0, 1)]
    words = sorted({w for k in (0, 1) for _, w in c[k]})
    lower = np.exp(toxicity.log_probabilities(np.array([[len({v for v, x in c[k] if x == w}) for w in words] for k in (0, 1)])))
    both = c[0] + c[1]

    def discounted(counts, v, w, p):
        own = {x: n for (u, x), n in counts.items() if u == v}
        return max(own.get(w, 0) - 0.75, 0) + 0.75 * len(own) * p, sum(own.values())

    cell = {w: int(memo[w] & ((1 << toxicity.WORD_BITS) - 1)) if w else 0 for w in (None, *words, "neverseen", "unheard")}
    assert len(set(cell.values())) == len(cell)
    after, checked = [*words, "unheard"], 0

    def placed(v, ws):
        follow = np.array([cell[v] << toxicity.WORD_BITS | cell[w] for w in ws], np.uint64)
        return follow, [(cell[v] >> toxicity.BLOCK_BITS, at) for at in toxicity.pair_cells(follow).tolist()]

    of_cell = {}
    for v, w in both:
        of_cell.setdefault(placed(v, [w])[1][0], set()).add((v, w))
    for v in (None, *words[::9], "neverseen"):
        keys = np.array([cell[w] << toxicity.CONTEXT_BITS for w in after], np.uint64)
        follow, cells = placed(v, after)
        if any(of_cell.get(at, set()) - {(v, w)} for w, at in zip(after, cells, strict=True)):
            continue  # pairs of one cell share their counts
        checked += 1
        _, got = model.probabilities(keys, follow)
        assert np.allclose(got.sum(1), 1, atol=1e-5)
        least = min(sum(n for (u, _), n in c[k].items() if u == v) for k in (0, 1))
        mass = toxicity.SHARED_PAIRS * least + 1
        for k in (0, 1):
            for i, w in enumerate(after):
                of_both, n = discounted(both, v, w, lower[k][i])
                own, total = discounted(c[k], v, w, lower[k][i])
                want = (own + mass * (of_both / n if n else lower[k][i])) / (total + mass)
                assert abs(got[k][i] - want) < 1e-5 * want
    assert checked > 20
    # A pair that toxic texts have and ordinary ones have not tells more than its words alone.
    made = [(i, "you are kind and the fool is here" if i % 2 else "kind of you the and fool are here is you", i % 2) for i in range(60)]
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    tables = toxicity.pair_counts(frame, 1).groupBy("block", "sub").applyInPandas(toxicity._counted, "block int, sub int, data binary")
    model = _model_of(tables)
    keys, follow, first, lengths = toxicity.keys_of(["the fool"], memo)
    alone, paired = model.differences(keys, follow)
    assert first.all() and lengths.tolist() == [2] and paired[1] > alone[1]


# ---- lines -------------------------------------------------------------------------------


def test_banded_distances():
    rng = random.Random(1)
    left = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(800)]
    right = [_varied(rng, a, 4, "abc") for a in left]
    for limit in range(4):
        want = [min(_edits(a, b), limit + 1) for a, b in zip(left, right, strict=True)]
        assert lines.edit_distances(left, right, limit).tolist() == want


def test_line_links_against_all_pairs(spark):
    rng, every = random.Random(2), []
    for _ in range(40):
        base = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 13)))
        every += [base, *(_varied(rng, base, 4, "abcd ") for _ in range(6))]
    docs = spark.createDataFrame([(i, "\n".join(every[i * 7 : i * 7 + 7])) for i in range(40)], "doc_id long, text string")
    name = lambda x: int(np.uint64(xxhash.xxh64_intdigest(x, 42)).astype(np.int64))
    distinct = sorted({x for x in every if len(x.encode().split()) >= 10})
    want = {}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if abs(len(a) - len(b)) <= 2 and (d := _edits(a, b)) <= 2:
                want[tuple(sorted((name(a), name(b))))] = d
    assert {(r.a, r.b): r.distance for r in lines.links(docs).collect()} == want
    roots = _roots([name(x) for x in distinct], want)
    first: dict = {}
    for doc in range(40):
        for no, line in enumerate(every[doc * 7 : doc * 7 + 7]):
            if name(line) in roots:
                first.setdefault(roots[name(line)], (doc, no))
    for r in lines.line_classes(docs).collect():
        own = every[r.doc_id * 7 : r.doc_id * 7 + 7]
        gone = [no for no, x in enumerate(own) if name(x) in roots and first[roots[name(x)]] != (r.doc_id, no)]
        assert r.removed == gone
        assert [first[roots[name(own[no])]] for no in r.line_nos] == list(zip(r.class_docs, r.class_lines, strict=True))
        assert r.links == sum(name(x) in pair for x in own for pair in want)


def test_short_lines_lose_no_link_where_they_are_joined(spark, monkeypatch):
    """With `min_words` of 1 the join takes lines of fewer characters than it has segments, too."""
    monkeypatch.setattr(lines, "TOGETHER", 3)
    rng = random.Random(5)
    distinct = sorted({"".join(rng.choice("ab") for _ in range(n % 6 + 1)) for n in range(120)})
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(distinct)], "doc_id long, text string").repartition(3)
    name = lambda x: int(np.uint64(xxhash.xxh64_intdigest(x, 42)).astype(np.int64))
    pairs = {tuple(sorted((name(a), name(b)))): _edits(a, b) for i, a in enumerate(distinct) for b in distinct[:i]}
    want = {pair: d for pair, d in pairs.items() if d <= 2}
    assert {(r.a, r.b): r.distance for r in lines.links(docs, min_words=1).collect()} == want
    got = {r.doc_id: r.links for r in lines.line_classes(docs, min_words=1).collect()}
    assert got == {i: sum(name(x) in pair for pair in want) for i, x in enumerate(distinct)}


def test_a_class_of_many_lines_gives_few_rows(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 50)
    monkeypatch.setattr(lines, "CELLS", 1000)
    every = [f"one line of ten words and more that ends in {c}{d} and so on" for c in string.ascii_letters for d in "abcdef"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(every)], "doc_id long, text string").repartition(7)
    made = lines._verified(docs, 2, 10, every=False).collect()
    n = len(every)
    assert len(made) < 200 * n < n * (n - 1) // 2 * 2
    found = lines.line_classes(docs).collect()
    assert {r.links for r in found} == {n - 1} and {tuple(r.class_docs) for r in found} == {(0,)}
    assert lines.links(docs).count() == n * (n - 1) // 2


def test_short_lines_are_classed_by_equality(spark):
    rng = random.Random(11)
    stock = ["Read more", "}", "Share this page", "a b c d e f g h i", "a b c d e f g h j", " Read more", "", "  \t "]
    texts = ["\n".join(rng.choice([*stock, f"only here {i} {k}"]) for k in range(8)) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first, count, want, left = {}, {}, {}, {}
    for i, text in enumerate(texts):
        own = text.split("\n")
        for no, x in enumerate(own):
            count[x] = count.get(x, 0) + 1
            first.setdefault(x, (i, no))
        gone = [no for no, x in enumerate(own) if x.strip() and first[x] != (i, no)]
        want[i], left[i] = gone, "\n".join(x for no, x in enumerate(own) if no not in gone)
    assert sum(map(len, want.values())) > 50
    for r in lines.line_classes(docs).collect():
        own = texts[r.doc_id].split("\n")
        assert r.removed == want[r.doc_id] and r.links == 0
        assert r.line_nos == [no for no, x in enumerate(own) if x.strip() and count[x] > 1]
        assert list(zip(r.class_docs, r.class_lines, strict=True)) == [first[own[no]] for no in r.line_nos]
    assert {r.doc_id: r.text for r in lines.without_repeats(docs).collect()} == left


def test_line_dedup_of_odd_rows(odd, empty):
    assert lines.line_classes(odd).count() == len(ODD)
    clean = lines.without_repeats(odd)
    assert clean.columns == odd.columns
    texts = {(r.doc_id, r.text) for r in clean.collect()}
    assert (3, None) in texts and (5, " \n\t\n ") in texts and (1, ODD[0][1]) in texts and (2, "") in texts and (6, LONG) in texts
    assert lines.line_classes(empty).count() == 0 and lines.without_repeats(empty).count() == 0


# ---- SimHash -----------------------------------------------------------------------------


def _plain_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark, odd):
    rng, rows = random.Random(6), []
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    for i in range(60):
        base = [rng.choice(words) for _ in range(300)]
        for k in range(5):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(300)] = rng.choice(words)
            rows.append((i * 5 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: _plain_fingerprint(t) for i, t in rows}
    pairs = [(a, b) for a, b in product(prints, prints) if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = _roots(prints, pairs)
    assert len(pairs) > 20
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {
        (i, f"{prints[i]:016x}", want[i]) for i in prints
    }
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}


def test_anchors_meet_every_near_pair(spark):
    rng, rows = random.Random(8), []
    for i in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(1, 3)):
            b ^= 1 << bit
        rows += [(i, 0, a), (i, 1, b)]
    signed = [(i, s, int(np.uint64(f).astype(np.int64))) for i, s, f in rows]
    frame = spark.createDataFrame(signed, "pair int, side int, fp long")
    keyed = simhash.anchored(frame.select("fp")).join(frame, F.col("id") == F.col("fp"))
    met = keyed.filter("role = 0 and side = 0").join(keyed.filter("role = 1 and side = 1").select("key", F.col("pair").alias("other")), "key")
    assert met.filter("pair = other").select("pair").distinct().count() == 400


def test_representatives(odd, empty):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 6, 7]
    assert simhash.representatives(empty).count() == 0


def _shingles(text: str) -> frozenset:
    words = text.encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicate_stage_against_all_pairs(spark):
    """Edited copies, a shared passage, a group of copies and tiny texts: what stays is what brute force keeps."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=40)
    texts = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(30, 300))
        texts.append(base)
        for edits in range(1, 6):
            texts.append([rng.choice(words) if rng.random() < edits / 100 else w for w in base])
    texts += [passage + rng.choices(words, k=rng.randint(5, 60)) for _ in range(60)]
    group = rng.choices(words, k=120)
    for _ in range(80):
        at = rng.randrange(120)
        texts.append(group[:at] + [rng.choice(words)] + group[at + 1 :])
    texts += [words[:n] for n in (0, 0, 1, 1, 4, 5, 6, 7)]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    sets = {i: _shingles(t) for i, t in rows}
    ids = sorted(sets)
    pairs = [
        (a, b) for k, a in enumerate(ids) for b in ids[:k]
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    far = [(a, b) for a, b in pairs if (_plain_bits(sets[a]) ^ _plain_bits(sets[b])).bit_count() > simhash.DISTANCE]
    assert len(far) > 50  # what fingerprints within 3 bits do not link
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(_roots(ids, pairs).values()))


def test_near_duplicate_stage_meets_sets_under_their_anchors(spark, monkeypatch):
    met, real = [], simhash.met_by_anchors
    monkeypatch.setattr(simhash, "met_by_anchors", lambda sets: met.append(real(sets).collect()) or real(sets))
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [[*base[:at], "other", *base[at + 1 :]] for at in range(0, 400, 40)] + [[f"x{rng.randrange(500)}" for _ in range(50)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 10]
    bits = {i: _plain_bits(_shingles(" ".join(t))) for i, t in enumerate(texts)}
    near = [(a, b) for a in bits for b in range(a) if (bits[a] ^ bits[b]).bit_count() <= simhash.DISTANCE]
    joined = _roots(sorted({r.a for r in met[0]} | {r.b for r in met[0]}), [(r.a, r.b) for r in met[0]])
    groups = Counter(Counter(_roots(sorted(bits), near).values()).values())
    assert Counter(Counter(joined.values()).values()) == Counter({n: k for n, k in groups.items() if n > 1}) and near


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.r_[a[n // 5 :], rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)])
        flipped = int(np.bitwise_count((overlap._sketch(a) ^ overlap._sketch(b)).view(np.uint64)).sum())
        assert flipped <= len(np.setxor1d(a, b)) and (n < 1000 or flipped > 200)


def test_wide_sketches_tell_large_sets_apart(spark):
    rng = np.random.default_rng(4)

    def wide(own, longs):
        out = overlap._wide_sketch(own)
        return out if len(out) == longs else out[:longs] ^ out[longs:]

    assert overlap._wide_sketch(np.arange(1024, dtype=np.uint64)) is None
    for n, m in ((1100, 1100), (2000, 2100), (9000, 8000)):
        a, other = (np.unique(rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2)) for k in (n, m))
        near = np.unique(np.r_[a[n // 10 :], other[: n // 10 + m - n]]) if m >= n else np.sort(a[:m])
        for b in (other, near):
            longs = min(len(overlap._wide_sketch(s)) for s in (a, b))
            flipped = int(np.bitwise_count((wide(a, longs) ^ wide(b, longs)).view(np.uint64)).sum())
            assert flipped <= len(np.setxor1d(a, b))
            assert (flipped * 9 > len(a) + len(b)) == (b is other)
    # Texts of thousands of words that share a rare passage are ruled out before their sets move.
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(["rare", "words", "that", "meet", f"in{i % 2}", *random.Random(i).choices(words, k=6000)]) for i in range(6)]
    docs = spark.createDataFrame([(i, t + (" end" if i else "")) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    sets = overlap._sets_of(docs, 5, 12).filter("n >= 0")
    first = sets.groupBy("id").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "fp", "sketch", "wide")])
    ids = sorted(r.id for r in first.select("id").collect())
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
    names = {r.id: r.first_id for r in first.collect()}
    moved, real = [], overlap.keep
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(overlap, "keep", lambda df: moved.append(out := real(df)) or out)
        patch.setattr(overlap, "discard", lambda *kept: None)
        found = overlap._compared(pairs, docs, first, 5, (4, 5)).collect()
    assert [{names[r.a], names[r.b]} for r in found] == [{0, 6}]
    assert [len(df.collect()) for df in moved if "own" in df.columns] == [2]


def _plain_bits(shingles) -> int:
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_a_chain_and_a_star(spark):
    rng = random.Random(3)
    names = [rng.getrandbits(60) for _ in range(400)]
    pairs = list(zip(names[:200], names[1:200], strict=False)) + [(names[200], n) for n in names[201:]] + [(names[0], names[0])]
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len({roots[n] for n in names[:200]}) == 1 and len({roots[n] for n in names[200:]}) == 1 and len(set(roots.values())) == 2


# ---- main text ---------------------------------------------------------------------------


def test_least_cut_against_all_labellings():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(0, 8)
        own = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.choice([0.05, 0.5, 1.0])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.4]

        def cost(label, own=own, edges=edges):
            return sum(abs(s) for s, x in zip(own, label, strict=True) if (s > 0) != x) + sum(w for a, b, w in edges if label[a] != label[b])

        least = min(cost(label) for label in product([False, True], repeat=n))
        assert cost(mincut.least_cut(own, edges)) == pytest.approx(least)


def test_main_text_of_a_page_with_everything():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1>
    <nav><a href=#>Home</a></nav></header><div class="cookie-notice">We use cookies to make this better, please accept.</div>
    <article><h1>Head&shy;line &amp; more</h1><p>First  paragraph\nwith <b>bold</b>&nbsp;words and a <a href=x>link</a>.<p>Short.
    <script>var t="</p>";</script><div class="ad">Buy now! Everything is cheap in our shop today.</div><p>It ends here.</article>
    <section id="comments"><p>Great article, thank you very much for writing it!</p></section><aside><p>Other stories that we like to show here.</p></aside>
    <form><p>Please give your name to get our letter every week.</p></form><footer>&copy; 2020. All rights reserved by all of us.</footer>"""
    assert mincut.main_text(page) == "Head\xadline & more\nFirst paragraph with bold words and a link.\nShort.\nIt ends here."


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "</p></p>", "<p a='", "&amp", "<script>x", "<div>" * 3000, "<!-- x"])
def test_broken_pages_do_not_fail(page):
    assert isinstance(mincut.main_text(page), str)


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some words are here, and they end.</p>", 1)] * 2 + [(None, None, None, 2)], "page_id long, url string, html string, text int")
    got = mincut.extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 34, 34] and mincut.extract(pages.limit(0)).count() == 0


# ---- packing -----------------------------------------------------------------------------


def test_packing_holds_every_id_once(spark, odd, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), table):
        got = packing.sequences(docs).toPandas()
        model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
        model.encode_special_tokens = True
        by_doc = {i: g.sort_values("start") for i, g in got.groupby("doc_id")}
        for row in docs.select("doc_id", "text").collect():
            ids = [*model.encode(row.text or "", add_special_tokens=False).ids, 1]
            own = by_doc[row.doc_id]
            assert np.concatenate([np.frombuffer(x, "<u2") for x in own.ids]).tolist() == ids
            assert (own.start == own.length.cumsum() - own.length).all() and (own.doc_tokens == len(ids)).all()
            for piece in own.itertuples():
                part = np.array(ids[piece.start : piece.start + piece.length], "<u4")
                assert piece.ids_crc32 == zlib.crc32(part.tobytes())
        ordered = got.sort_values(["sequence_id", "offset"])
        assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
        filled = got.groupby("sequence_id").length.sum()
        assert all(n <= 2048 and n & (n - 1) == 0 or n == 2048 for n in filled)
    assert packing.sequences(odd).groupBy().sum("length").first()[0] > 0
    assert packing.sequences(empty).count() == 0


@pytest.mark.parametrize("name, ranked", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_tokenizer(name, ranked):
    model = Tokenizer.from_file(public_tokenizers.path(name))
    model.encode_special_tokens = True
    assert bool(packing._ranks(json.loads(model.to_str()))) is ranked
    rng = random.Random(5)
    pieces = ["'s", "don't", " ", "  ", "\n", "\u3000", "12", "é", "漢字", "\U0001f600", "<|endoftext|>", "--", "Word", "\x00"]
    texts = ["", LONG, " " * 100_000, "a" * 100_000] + ["".join(rng.choices(pieces, k=40)) for _ in range(300)]
    texts += [f"a{chr(c)}{chr(c)}1 {chr(c)}" for c in range(0, 0x11_0000, 7) if not 0xD800 <= c < 0xE000]
    encode = packing.encoder(public_tokenizers.path(name))
    for text, right in zip(texts, model.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == right.ids


def test_a_worker_makes_its_encoder_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    packing._model.cache_clear()
    encode = packing.encoder(path)
    assert len(encode("plain words")) and packing.encoder(path) is encode and not packing._model.cache_info().currsize


def test_hilbert_places_are_a_walk_through_all_cells():
    bits = 2
    cells = np.array(list(product(range(4), repeat=packing.DIMS)))
    places = packing._hilbert(cells, bits)
    walk = cells[np.argsort(places)]
    assert sorted(places) == list(range(4**packing.DIMS)) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


# ---- search ------------------------------------------------------------------------------


def test_search_with_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(6)]) for i in range(300)]
    rows += [(20, [1.0] * 6), (301, [1.0] * 6), (302, None), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (304, [float("nan")] * 6), (305, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (340, [1e30] * 6), (360, [2.0**40] + [0.0] * 5), (361, [0.0] * 5 + [-(2.0**40)]), (306, [0.5] * 3), (400, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_products(table, shard_rows=64).collect()
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v):
            good.append((i, [max(-(1 << 62), min(1 << 62, int(np.floor(64 * float(np.float32(x)))))) for x in v]))
    asked: dict = {}
    for i, v in good:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    want = []
    for q, v in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)[:20]
        want += [(q, rank, i, -s if -(1 << 63) <= -s < 1 << 63 else None) for rank, (s, i) in enumerate(scored, 1)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert {-(2**46) * 64, None} & {r.score for r in got} and topk.top_products(table.limit(0)).count() == 0


def test_columns_named_like_our_own_pass_through(spark):
    rows = [(1, "same line here\nand more of it", "a", *range(1, 8)), (2, "same line here\nsomething else", "a", *range(2, 9)), (3, "other words", "b", *range(3, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _key int, _KEY_ int, _doc int, _gone int, _times int, _time int, _row int")
    given = {r[0]: r[3:] for r in rows}
    for out in (simhash.representatives(docs), mixture.mixed(docs), lines.without_repeats(docs)):
        got = out.collect()
        assert out.columns == docs.columns and got and all(tuple(r)[3:] == given[r.doc_id] for r in got)
    assert lines.without_repeats(docs).filter("doc_id = 2").first().text == "something else"


# ---- pages and texts that are hard to read ------------------------------------------------

#: The tags, comments and texts of a page as one pattern; it takes quadratic time on broken pages.
PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|[^<]+|<", re.S)


def test_pieces_are_those_of_the_pattern():
    rng = random.Random(1)
    for _ in range(5000):
        page = "".join(rng.choice("<<>\"'a /!-?b= é") for _ in range(rng.randint(0, 30)))
        at, pieces = 0, mincut.Pieces(page)
        while at < len(page):
            found = PIECE.match(page, at)
            want = (found.end(), found[2], bool(found[1]), found[3] or "")
            assert pieces.next(at)[:4] == want, page
            at = found.end()


@pytest.mark.parametrize("part", ['<a "', "<a ", "<a", '<a"', "</a <b'", "<div>Yes.</div><div>word</div>"])
def test_broken_and_alternating_pages_take_linear_time(part):
    started = time.perf_counter()
    mincut.main_text(part * (1_000_000 // len(part)))
    assert time.perf_counter() - started < 60  # hours, if each opening looked through the rest of the page


def test_flow_separates_as_shortest_paths_do():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 10)
        scores = [rng.choice([-2.0, -1, -0.5, 0.5, 1, 2]) * rng.random() for _ in range(n)]
        edges = [(a, b, rng.choice([0.05, 0.5, 1.0])) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(15)) if a != b]

        def cost(label):
            return sum(abs(s) for s, x in zip(scores, label) if (s > 0) != x) + sum(w for a, b, w in edges if label[a] != label[b])

        assert abs(cost(mincut.least_cut(scores, edges)) - min(cost(x) for x in product([False, True], repeat=n))) < 1e-6


def test_long_runs_of_spaces_have_the_ids_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "x" + " " * 2_000_000 + "a"
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


# ---- mixing ------------------------------------------------------------------------------


def test_mix_targets_and_limits(spark, odd, empty):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 40), "big" if i % 3 else f"s{i % 7}") for i in range(900)] + [(1000, "w " * 3000, None), (1001, None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture.mix(docs).toPandas()
    sums = got.groupby(got.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    assert (abs(sums.taken - sums.target) <= 0.5).all() and (sums.target <= 3 * sums["size"]).all()
    assert sums.target.sum() == pytest.approx(got["size"].sum())
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sums.index))}
    free = {s: sums.target[s] / weights[s] for s in sums.index if sums.target[s] < 3 * sums["size"][s] - 1e-9}
    assert max(free.values()) == pytest.approx(min(free.values()))
    assert mixture.mix(docs).toPandas().sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()
    assert mixture.mix(odd).count() == len(ODD) and mixture.mix(empty).count() == 0
    assert mixture.mixed(odd).columns == odd.columns and mixture.mixed(empty).count() == 0


def test_schedule_gives_each_source_its_slots_evenly(spark):
    sized = spark.createDataFrame([("a", 1000), ("b", 4000), ("c", 5000)], "source string, size long")
    sources = mixture.plan(mixture.targets(sized), 500)
    total = sources.agg(F.sum("need")).first()[0]
    slots = mixture.schedule(sources, total).toPandas()
    need = {r.source_no: r.need for r in sources.collect()}
    assert sorted(slots.t) == list(range(total))
    for source, own in slots.groupby("source_no"):
        assert sorted(own["rank"]) == list(range(need[source]))
        for at in (total // 4, total // 2):
            assert abs((own.t < at).sum() - need[source] * at / total) < 8


# ---- URL rules ---------------------------------------------------------------------------


def test_url_parts_and_fixed_rules(spark):
    rows = [
        ("HTTP://WWW.Example.ORG/es/1?x=1", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/1x", "example.org", "/en/1x", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://a.org?q", "a.org", "", None, "allow"),
        ("x://b.com/de/#y", "b.com", "/de/", "com/de/", "block"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, r[0], "h") for i, r in enumerate(rows)], "page_id long, url string, rule string")
    got = sorted(tuple(r) for r in urlrules.judge(pages).collect())
    assert [g[:4] for g in got] == [(i, *r[1:4]) for i, r in enumerate(rows)]
    assert [g[4] for g in got if g[3]] == [r[4] for r in rows if r[3]]
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_mined_rules_against_counting(spark):
    rng = random.Random(11)
    urls = [f"http://{rng.choice('abc')}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'fr', 'es', 'en'])}/{rng.choice('xyz')}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    pages = pages.withColumns({"host": urlrules.host_of(), "path": urlrules.path_of()})
    rule, verdict = urlrules.fitting_rule(urlrules.FIXED_RULES)
    rows = pages.select("url", urlrules.tokens_of().alias("tokens"), rule.alias("rule"), verdict.alias("verdict")).collect()
    labelled = [(frozenset(r.tokens), r.verdict) for r in rows if r.rule]
    rules = {}
    for tokens in {c for t, _ in labelled for c in _subsets(t)}:
        for says in ("allow", "block"):
            both = sum(tokens <= t and v == says for t, v in labelled)
            if both >= 0.005 * len(labelled) and both / sum(tokens <= t for t, _ in labelled) >= 0.8:
                rules[tokens, says] = (both / sum(tokens <= t for t, _ in labelled), both / len(labelled))
    want = {}
    for r in rows:
        fits = [(-c, -s, -len(t), " ".join(sorted(t)), v) for (t, v), (c, s) in rules.items() if t <= set(r.tokens)]
        want[r.url] = r.verdict or (min(fits)[4] if fits else "allow")
    got = urlrules.judge(pages).join(pages.select("page_id", "url"), "page_id").collect()
    assert {r.url: r.verdict for r in got} == want


def _subsets(tokens):
    items = sorted(tokens)
    return [frozenset(x for k, x in enumerate(items) if m >> k & 1) for m in range(1, 1 << len(items))]


# ---- queries and pipeline ----------------------------------------------------------------


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).fetchdf()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda frame: sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)
    assert key(got) == key(want)


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == before.columns, name
    assert corpus_pipeline.run(spark, SF).groupBy().sum("length").first()[0] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, odd.limit(0), SF).count() == 0
