"""Token counts, packing, quality rules, toxicity and mixing against brute force, and their edge cases."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockloom.llm.mixing import SCHEDULES, mixed, mixing
from blockloom.llm.packing import CAPACITY, best_fit, best_fit_packing, encoder
from blockloom.llm.quality_rules import keep_good, quality_rules, text_counts
from blockloom.llm.token_counts import counter, load_merges, token_counts
from blockloom.llm.toxicity import severity, train

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, counts string, Verdict int, place int"
NASTY = [
    "",
    " ",
    "\n\n a",
    "a  b\t\nc \n d",
    "don't WE'LL 's",
    "x<|endoftext|>y <|endoftext|>",
    "<|startoftext|> a",
    "\x1c a\x1fb \x85c\xa0d",
    "́e é ẞ İ ΣΑΣ",
    "\U0001f600\U0001f600 中文 1234 5",
    "a" * 5000,
    "ab" * 3000 + " " + "é" * 2000,
]


def frame(spark, rows):
    full = [(i, t, lang, src, None if t is None else len(t), "x", 1, 2) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, text, "en", f"s{i % 3}") for i, text in enumerate(NASTY)]
    rows += [(100, None, None, None), (None, "some words of a text", None, "s1"), (7, "again", "de", None), (7, "again", "de", None)]
    rows += [(200, "long word " * 30_000, "en", "s0")]
    return frame(spark, rows)


def test_token_counts_are_those_of_the_library(odd_docs):
    lib = Tokenizer.from_file(BYTE_BPE)
    got = token_counts(odd_docs, BYTE_BPE, 512).collect()
    want = [
        (r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids))
        for r in odd_docs.collect()
    ]
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts(odd_docs.limit(0), BYTE_BPE, 512).collect() == []


def test_token_counts_of_random_texts():
    lib, count, rng = Tokenizer.from_file(BYTE_BPE), counter(*load_merges(BYTE_BPE)), random.Random(3)
    signs = [" ", "a", "th", "\n", ".", "1", "'s", "՘", "࢏", "\U0003134b", "\x85", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice([*signs, chr(rng.randrange(32, 0x2FFF))]) for _ in range(rng.randrange(1, 14)))
        assert count(text) == len(lib.encode(text, add_special_tokens=False).ids), repr(text)


def check_packing(docs, packed):
    lib = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in docs:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), CAPACITY)):
            part = np.array(ids[start : start + CAPACITY], "<u4")
            want[r.doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= CAPACITY
    return len(bins), sum(r.length for r in packed)


def test_packing_round_trip(spark, sf, odd_docs):
    check_packing(odd_docs.collect(), best_fit_packing(odd_docs, WORD_BPE).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    used, tokens = check_packing(docs.collect(), best_fit_packing(docs, WORD_BPE).collect())
    assert used <= tokens / CAPACITY * 1.02 + 1
    assert best_fit_packing(docs.limit(0), WORD_BPE).collect() == []


def test_the_encoder_remembers_a_bounded_number_of_words():
    with open(WORD_BPE, encoding="utf-8") as file:
        encode = encoder(file.read())
    rng = random.Random(6)
    often = "The often-met words, of every text. "
    first = encode([often])
    for _ in range(30):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(20_000)]
        assert encode([often + " ".join(words), often])[1] == first[0]
    held = [cell.cell_contents for cell in encode.__closure__ if isinstance(cell.cell_contents, dict)]
    assert 0 < sum(len(word) for words in held for word in words) < 5 << 20


def test_packing_with_a_vocabulary_that_keeps_white_space(spark, odd_docs):
    lib = Tokenizer.from_file(BYTE_BPE)
    packed = best_fit_packing(odd_docs, BYTE_BPE).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), CAPACITY):
            want[r.doc_id, start, zlib.crc32(np.array(ids[start : start + CAPACITY], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in packed) == want


def test_what_is_broadcast_needs_no_package(spark, odd_docs, monkeypatch):
    """Broadcasts are pickled plainly: nothing of this package may be in them."""
    sent = []
    plain = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or plain(value))
    best_fit_packing(odd_docs, WORD_BPE).count()
    labels = odd_docs.filter("doc_id < 10").selectExpr("doc_id", "cast(doc_id % 3 as int) as grade")
    severity(odd_docs, train(odd_docs, labels)).count()
    token_counts(odd_docs, BYTE_BPE, 512).count()
    assert len(sent) >= 4 and not any(b"blockloom" in value for value in sent)


def test_best_fit_takes_the_tightest_bin():
    assert sorted(map(sorted, best_fit([6, 5, 4, 3, 2], 10))) == [[0, 2], [1, 3, 4]]
    assert best_fit([], 10) == []
    assert len(best_fit([10] * 5, 10)) == 5


def slow_counts(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    words = word.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {p for starts in windows.values() if len(starts) > 1 for i in starts for p in range(i, i + 5)}
    lines = [line for line in text.split("\n") if word.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_counts():
    rng = random.Random(5)
    for text in [*NASTY, None, "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n\nx"]:
        assert text_counts(text) == slow_counts(text)
    for _ in range(500):
        text = "".join(rng.choice(["a ", "b ", "c\n", "#", "d\x0b", "\xa0", "e\x0c"]) for _ in range(rng.randrange(60)))
        assert text_counts(text) == slow_counts(text)


def test_quality_keeps_clean_and_drops_odd(spark, odd_docs):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(20, 90)), "en", "big" if i % 3 else f"s{i % 7}") for i in range(400)]
    junk = [(1000 + i, " | ".join(text(40).split()), "en", "big") for i in range(20)]
    got = {r.doc_id: r for r in quality_rules(frame(spark, rows + junk)).collect()}
    assert all(got[i].kept for i in range(400))
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(20))
    odd = quality_rules(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in odd)
    assert not any(r.kept for r in odd if r.base_failed)
    kept = keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(r.kept for r in odd)
    assert quality_rules(odd_docs.limit(0)).collect() == []


def test_toxicity_on_held_out_texts(spark, odd_docs):
    rng = random.Random(2)
    plain = [f"w{rng.randrange(3000)}" for _ in range(3000)]

    def text(grade):
        harsh = [f"bad{rng.randrange(5)}" for _ in range(2)] * (grade > 0) + [f"worst{rng.randrange(5)}" for _ in range(3)] * (grade > 1)
        found = [rng.choice(plain) for _ in range(rng.randrange(20, 400))] + harsh
        rng.shuffle(found)
        return " ".join(found)

    grades = [rng.choice([0, 0, 0, 1, 2]) for _ in range(1500)]
    docs = frame(spark, [(i, text(g), "en", "s") for i, g in enumerate(grades)])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 2] + [(None, 1), (3, None)], "doc_id long, grade int")
    model = train(docs, labels)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in severity(docs, model).collect()}
    held_out = [i for i in range(1500) if i % 2 == 0]
    assert sum((got[i].grade > 0) == (grades[i] > 0) for i in held_out) >= 0.97 * len(held_out)
    assert sum(got[i].grade == grades[i] for i in held_out) >= 0.9 * len(held_out)
    assert all(0 <= r.expected_severity <= 2 for r in got.values())
    assert severity(odd_docs, model).count() == odd_docs.count()
    assert severity(odd_docs.limit(0), model).collect() == []
    flat = train(docs, labels.filter("grade = 1"))
    assert {(r.expected_severity, r.grade) for r in severity(odd_docs, flat).collect()} == {(1.0, 1)}
    none = train(docs, labels.limit(0))
    assert {r.grade for r in severity(odd_docs, none).collect()} == {0}


def slow_targets(sizes, weights=(3, 1, 2)):
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in sources if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = 2 * sizes[s]
            left -= capped[s]


def test_mixing_targets_and_whole_documents(spark, odd_docs):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(["hot"] * 6 + ["b", "é", "Z", None])) for i in range(3000)]
    rows += [(5, "same row", "en", "b")] * 3
    docs = frame(spark, rows)
    got = mixing(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    want = slow_targets(sizes)
    by_target = defaultdict(lambda: [0, 0])
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by_target[r.source_size][0] = r.target
        by_target[r.source_size][1] += r.taken
    for source, size in sizes.items():
        target, taken = by_target[size]
        assert target == pytest.approx(want[source])
        assert abs(taken - target) <= 60
    assert Counter(mixing(docs.repartition(5)).collect()) == Counter(got)
    assert mixing(odd_docs).count() == odd_docs.count()
    assert mixing(odd_docs.limit(0)).collect() == []

    out = mixed(docs, position="at").collect()
    assert Counter(r.doc_id for r in out if r.doc_id > 5)[6] == next(r.taken // max(1, r.size) for r in got if r.doc_id == 6)
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in got)
    at = [r["at"] for r in out]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    # The first source by code point has a falling weight, so most of it comes in the first half.
    first = [r["at"] for r in out if r.source == "Z"]
    assert SCHEDULES[0][0] > SCHEDULES[0][1] and np.mean(np.array(first) < 0.5) > 0.55
    assert mixed(odd_docs).columns == odd_docs.columns
    assert mixed(odd_docs.limit(0)).collect() == []


def slow_positions(rows, taken):
    """Positions of the copies of each id, from the content hash and a running sum per source; ids differ."""
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    targets, placed = slow_targets(sizes), defaultdict(list)
    for i, text, _, source in rows:
        joined = "\x1f".join([str(i), source or "", text])
        placed[source].append((int(hashlib.md5(joined.encode()).hexdigest()[:15], 16), i, len(text.split())))
    out = {}
    for rank, source in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode()))):
        begin, end = SCHEDULES[rank % len(SCHEDULES)]
        words = 0
        for _, i, size in sorted(placed[source]):
            shares = [min(1, (copy * sizes[source] + words) / targets[source]) for copy in range(taken[i] // max(1, size))]
            # begin * t + (end - begin) * t^2 / 2 = share, by halving
            out[i] = []
            for share in shares:
                low, high = 0.0, 1.0
                for _ in range(60):
                    t = (low + high) / 2
                    low, high = (t, high) if begin * t + (end - begin) * t * t / 2 < share else (low, t)
                out[i].append(low)
            words += size
    return out


def test_mixing_gets_its_rows_through_their_positions(spark):
    rng = random.Random(9)
    sources = ["hot"] * 6 + ["b", "é", "Z", None]
    rows = [(i, "w " * rng.randrange(0, 60), "en", rng.choice(sources)) for i in range(800)]
    rows += [(900, "long " * 9000, "en", "b")]
    docs = frame(spark, rows)
    got = mixing(docs, positions="at").collect()
    want = slow_positions(rows, {r.doc_id: r.taken for r in got})
    assert sum(len(r["at"]) for r in got) > 800
    for r in got:
        assert r["at"] == pytest.approx(want[r.doc_id], abs=1e-9)
    firsts = [r["at"][0] if r["at"] else 2 for r in got]
    assert firsts == sorted(firsts)
    # The registered form has the same rows in the same order, and that order follows the schedule.
    assert [r.doc_id for r in mixing(docs).collect()] == [r.doc_id for r in got]
    flat = mixing(docs, schedules=((1.0, 1.0),)).collect()
    assert [r.doc_id for r in flat] != [r.doc_id for r in got] and set(flat) == set(mixing(docs).collect())


def test_toxicity_knows_each_grade_by_words_of_its_own(spark):
    rng = random.Random(6)
    own = {0: "good", 1: "poor", 2: "worst"}

    def text(grade):
        found = [f"w{rng.randrange(2000)}" for _ in range(60)] + [f"{own[grade]}{rng.randrange(5)}" for _ in range(3)]
        rng.shuffle(found)
        return " ".join(found)

    grades = [rng.choice([0, 0, 0, 1, 2]) for _ in range(1500)]
    docs = frame(spark, [(i, text(g), "en", "s") for i, g in enumerate(grades)])
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i % 2], "doc_id long, grade int")
    got = {r.doc_id: r for r in severity(docs, train(docs, labels)).collect()}
    for grade in own:
        held_out = [i for i in range(0, 1500, 2) if grades[i] == grade]
        assert sum(got[i].grade == grade for i in held_out) >= 0.9 * len(held_out), grade
