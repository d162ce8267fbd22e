"""Neighbours, near-duplicates, lines, URLs and chats against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from blockloom.llm import line_dedup
from blockloom.llm.components import connected
from blockloom.llm.line_dedup import dedup_lines, line_duplicates
from blockloom.llm.near_dedup import BINS, near_duplicates, one_of_each, sketch
from blockloom.llm.preference_chat import preference_pairs, rendered, trained_chars, weaker
from blockloom.llm.prefix_forest import nearest
from blockloom.llm.url_filters import url_verdicts
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed int, of string, bands int, cls int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", 2, 3) for i, t in rows], DOCS)


def groups(nodes, links):
    """Smallest member of each node's group."""
    at = {n: n for n in nodes}

    def find(n):
        while at[n] != n:
            at[n] = at[at[n]]
            n = at[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return {n: find(n) for n in nodes}


def test_connected_groups(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    wild = [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(150)]
    edges = chain + star + wild + [(5, 5), (None, 1), (3, 2)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups({n for e in clean for n in e}, clean)
    assert set(got) == set(want)
    assert len({(got[n], want[n]) for n in want}) == len(set(want.values())) == len(set(got.values()))
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_nearest(rows, asked, k):
    usable = [
        (i, np.array(v, float))
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)
    ]
    out = {}
    for at, (i, v) in enumerate(usable):
        if asked(i):
            scored = [
                (-float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), j)
                for other, (j, w) in enumerate(usable)
                if other != at and len(w) == len(v)
            ]
            out[i] = sorted(scored)[:k]
    return out


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.4 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(2500)]
    rows += [(5000 + i, rows[0][1]) for i in range(900)]  # one very common vector
    rows += [(9000, None), (9050, []), (9100, [0.0] * 24), (9150, [None] * 24), (9200, [float("nan")] * 24)]
    rows += [(9250, [float("inf")] * 24), (None, [1.0] * 24), (9300, [1.0, 2.0]), (9350, [2.0, 4.0])]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for r in nearest(frame_, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    hits = 0
    for i, best in want.items():
        assert [rank for rank, _, _ in got[i]] == list(range(1, len(best) + 1))
        assert i not in [j for _, j, _ in got[i]]
        exact = {j: -s for s, j in best}
        hits += sum(j in exact for _, j, _ in got[i])
        assert all(abs(s - exact[j]) < 1e-12 for _, j, s in got[i] if j in exact)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert [j for _, j, _ in got[5050]] == [0, 5000, 5001, 5002, 5003]
    assert nearest(frame_.limit(0), F.col("id") % 50 == 0).collect() == []


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute_near(rows, size, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    links = [
        (a, b)
        for a, b in combinations(range(len(rows)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = groups(range(len(rows)), links)
    smallest = {}
    for n, r in root.items():
        i = rows[n][0]
        smallest[r] = i if smallest.get(r) is None else smallest[r] if i is None else min(i, smallest[r])
    return [(rows[n][0], len(sets[n]), smallest[root[n]] if sets[n] else rows[n][0]) for n in range(len(rows))]


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows, base = [], text(120)
    for i in range(60):  # variants of one text, not all similar to each other
        copy = list(base)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((i, " ".join(copy)))
    step = text(100)
    for i in range(30):  # a chain: each close to the next, the ends far apart
        step = list(step)
        step[i * 3] = f"new{i}"
        rows.append((200 + i, " ".join(step)))
    shared = text(60)
    rows += [(400 + i, " ".join(shared + text(40))) for i in range(40)]
    rows += [(600 + i, " ".join(text(rng.randrange(1, 80)))) for i in range(150)]
    rows += [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (None, rows[0][1]), (0, rows[0][1]), (None, "lonely null id text")]
    rows += [(950, "x y"), (951, "x  y"), (952, "word " * 60_000)]
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_are_the_exact_components(spark, near_rows, size):
    got = near_duplicates(frame(spark, near_rows), size=size).collect()
    want = Counter(brute_near(near_rows, size))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(frame(spark, []), size=size).collect() == []


def test_one_of_each_near_group_stays(spark, near_rows):
    docs = frame(spark, near_rows)
    kept = one_of_each(docs, size=2)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    component = brute_near(near_rows, 2)
    with_words = {(c, n) for (_, n, c), (_, t) in zip(component, near_rows, strict=True) if n and c is not None}
    ids = {c for c, _ in with_words}
    assert {i for i, t in got if t and t.split() and i is not None} == ids
    assert all(n == 1 for (i, t), n in got.items() if t and t.split())
    assert sum(n for (i, t), n in got.items() if not (t and t.split())) == 3


def test_sketches_fill_every_coordinate_and_agree_by_similarity():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 150, 5000):
        assert (sketch(rng.integers(0, 2**63, n).astype(np.uint64)) != 0).sum() >= BINS - 1
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    agree = [(sketch(pool[k : k + 900]) == sketch(pool[k + 100 : k + 1000])).mean() for k in range(0, 200, 5)]
    assert abs(np.mean(agree) - 0.8) < 0.02


def slow_line(line):
    return re.sub(r"([^\w]|_)+", " ", line.lower()).strip()


def slow_keys(line):
    """Choices of parts of a normalised line, each part as the majority bits of its words' hashes."""
    hashes = [xxh64_intdigest(w.encode(), 42) for w in line.split(" ")]
    n = len(hashes)
    coarse = lambda x: x >> max(x.bit_length() - 3, 0) << max(x.bit_length() - 3, 0)
    q = coarse(n // 4)
    keys = set()
    for q in [q, coarse(q - 1)] if q > 1 and 90 * n < 400 * q else [q]:
        parts = [tuple(hashes[at : at + q]) for at in (0, q, n - 2 * q, n - q)]
        if q <= 15:
            parts = [tuple(sum(h >> bit & 1 for h in part) > q // 2 for bit in range(15)) for part in parts]
        if q == 1:
            keys |= {("all", *parts), ("first", *hashes[:3]), ("last", *hashes[-3:])}
        else:
            keys |= {(q, choice, *[parts[p] for p in choice]) for choice in combinations(range(4), 2)}
    return keys


def edits(a, b):
    other, at = np.array(list(b)), np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a, 1):
        step = np.concatenate([[i], np.minimum(row[:-1] + (other != x), row[1:] + 1)])
        row = np.minimum.accumulate(step - at) + at
    return int(row[-1])


def brute_lines(rows):
    """Removed places by (id, text)."""
    places = defaultdict(set)
    for i, text in rows:
        for pos, line in enumerate(text.split("\n") if text else []):
            if len(slow_line(line).split(" ")) >= 5:
                places[slow_line(line)].add((i is None, i, text, pos))
    lines = sorted(places)
    keys = {line: slow_keys(line) for line in lines}
    links = [(a, b) for a, b in combinations(lines, 2) if keys[a] & keys[b] and edits(a, b) <= max(len(a), len(b)) * 20 // 100]
    root = groups(lines, links)
    occurrences = defaultdict(set)
    for line in lines:
        occurrences[root[line]] |= places[line]
    removed = defaultdict(set)
    for found in occurrences.values():
        smallest = min(x[:2] for x in found)
        ties = [x for x in found if x[:2] == smallest]
        assert len({x[2] for x in ties}) == 1  # texts of equal ids would need their hash
        keeper = min(ties, key=lambda x: x[3])
        for x in found - {keeper}:
            removed[x[1], x[2]].add(x[3])
    return removed


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    popular = [line(12), line(30), line(150)]
    long = line(120).split(" ")
    rows = []
    for i in range(40):
        lines = [line(rng.randrange(2, 20)) for _ in range(rng.randrange(1, 5))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(popular).upper() if i % 2 else rng.choice(popular))
        near = list(long)
        near[rng.randrange(120)] = rng.choice(words)
        lines.append(" ".join(near))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, rows[3][1]), (7, rows[7][1]), (103, popular[0] + "\n" + popular[0])]
    return rows


def test_fuzzy_lines_against_brute_force(spark, line_rows):
    docs = frame(spark, line_rows)
    want = brute_lines(line_rows)
    got = line_duplicates(docs).collect()
    assert len(got) == len(line_rows)
    texts = defaultdict(list)
    for i, text in line_rows:
        texts[i].append(text)
    for r in got:
        text = texts[r.doc_id][0]
        assert r.removed == sorted(want.get((r.doc_id, text), ())), r.doc_id
        assert r.n_removed == len(r.removed) and r.n_lines == (len(text.split("\n")) if text is not None else 0)
    assert sum(r.n_removed for r in got) > 60
    clean = dedup_lines(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        text = texts[r.doc_id][0]
        gone = want.get((r.doc_id, text), ())
        left = text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert r.text == left and r.n_chars == (None if left is None else len(left))
    assert line_duplicates(frame(spark, [])).collect() == []


def changed(words, rng, times, fresh):
    """A line with so many words changed, added or taken away."""
    words = list(words)
    for _ in range(times):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = fresh()
        elif kind == 1:
            words.insert(at, fresh())
        elif len(words) > 5:
            del words[at]
    return words


def test_recall_against_edit_similarity_alone(spark):
    """Every pair of a line and a changed one that are similar enough are linked, by length and number of changes."""
    rng = random.Random(21)
    fresh = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    rows, similar = [], defaultdict(list)
    for n in (5, 6, 7, 8, 11, 12, 16, 20, 30, 50, 63, 64, 71, 72, 100, 300):
        for times in (1, 2):
            for _ in range(25):
                words = [fresh() for _ in range(n)]
                a, b = " ".join(words), " ".join(changed(words, rng, times, fresh))
                if edits(a, b) <= max(len(a), len(b)) * 20 // 100:
                    similar[n, times].append(len(rows))
                rows.append((len(rows), f"{a}.\n{b}"))
    linked = {r.doc_id for r in line_duplicates(frame(spark, rows)).collect() if r.n_removed}
    share = {k: sum(i in linked for i in at) / len(at) for k, at in similar.items()}
    assert all(found == 1 for (n, times), found in share.items() if times == 1), share
    twice = [i for (_, times), at in similar.items() for i in at if times == 2]
    print({k: round(v, 2) for k, v in share.items()}, sum(i in linked for i in twice) / len(twice))
    assert sum(i in linked for i in twice) >= 0.8 * len(twice), share
    assert linked <= {i for at in similar.values() for i in at}


def test_keys_of_lines_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    rng = random.Random(3)
    text = "\n".join(" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in range(5, 40))
    keys = []
    for size in (1, 200 << 30):
        monkeypatch.setattr(line_dedup, "stored_size", lambda df, size=size: size, raising=False)
        keys.append({r.pos: r["keys"] for r in line_dedup._lines(frame(spark, [(1, text)])).collect()})
    assert keys[0] == keys[1] and len(keys[0]) == 35


def test_lines_without_common_words_do_not_meet(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(f"{rng.getrandbits(40):x}" for _ in range(8)) for _ in range(100))) for i in range(200)]
    lines = line_dedup._lines(frame(spark, rows))
    assert lines.count() == 20_000 and line_dedup._candidates(line_dedup._classes(lines)).isEmpty()


def test_pairs_of_lines_are_dealt_by_their_number(spark):
    pairs = spark.range(12_000, numPartitions=1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    dealt = line_dedup._dealt(pairs)
    assert dealt.rdd.getNumPartitions() == 3 and dealt.exceptAll(pairs).isEmpty() and dealt.count() == 12_000


def test_only_wanted_lines_and_few_others_are_shuffled(spark):
    rows = spark.range(200_000).select("id", F.xxhash64("id").alias("number"))
    wanted = rows.filter("id % 100 = 7").withColumnRenamed("number", "of")
    got = {r.id for r in line_dedup._only(rows, F.col("number"), wanted, F.col("of")).collect()}
    assert got >= set(range(7, 200_000, 100)) and len(got) < 2_200


def test_words_of_a_line_are_counted_after_normalising(spark):
    rng = random.Random(12)
    short = " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(200))
    other = short[:-2] + "q" + rng.choice("uvw")
    parted = ["one two three four five", "one\ttwo\tthree\tfour\tfive", "One\u00a0two\u00a0three\u00a0four\u00a0five", "one,two;three.four:five"]
    alone = ["        }", "- - - - -", "| | | | |", "          ", "        return none", "\t\treturn a b c", "a b c d", "", "a.b.c.d."]
    rows = [(i, "\n".join([line, *alone, short if i % 2 else other])) for i, line in enumerate(parted)]
    rows += [(10, "a b c d e\nA-B-C-D-E\nİİİİİ\nİİİİİ")]
    got = {r.doc_id: r.removed for r in line_duplicates(frame(spark, rows)).collect()}
    last = len(alone) + 1
    assert got == {0: [], 1: [0, last], 2: [0, last], 3: [0, last], 10: [1, 3]}


def test_fuzzy_lines_of_short_and_oddly_parted_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)] + [f"word{i}" for i in range(150)]
    parts = [" ", " ", " ", "\t", "\u00a0", ", ", "  "]
    line = lambda n: "".join(rng.choice(words) + rng.choice(parts) for _ in range(n)) + "."
    popular, long = [line(12), line(30)], line(60).split(" ")
    rows = []
    for i in range(60):
        lines = [line(rng.randrange(2, 20)) for _ in range(rng.randrange(1, 5))]
        lines.insert(rng.randrange(len(lines) + 1), rng.choice(popular).upper() if i % 2 else rng.choice(popular))
        near = list(long)
        near[rng.randrange(len(long))] = rng.choice(words)
        rows.append((i, "\n".join([*lines, " ".join(near)])))
    want = {i: sorted(at) for (i, _), at in brute_lines(rows).items()}
    got = line_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.removed for r in got if r.removed} == want
    assert sum(r.n_removed for r in got) > 60


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.Example.com", "/en/"), ("block", "net", "/es"), ("block", "b.c", "")]


def slow_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(c.lower() if c.isascii() else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [
        (len(h + p), h.lower() + p, v)
        for v, h, p in RULES
        if (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)
    ]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    blocked = url and re.search(r"[/?&.=_-]casino([/?&.=_#-]|$)|/login([/?#]|$)|\.jpg([?#]|$)", url.lower())
    return host, path, None, "block" if blocked else "allow"


def test_url_verdicts(spark):
    rng = random.Random(9)
    hosts = ["a.com", "EXAMPLE.com", "www.example.com", "x.www.example.com", "notexample.com", "d.net", "b.c", "x.b.c", "é.org", "net", "com", "com:80"]
    paths = ["", "/", "/en/", "/en/1", "/es", "/estonia/x", "/EN/", "/login", "/a/casino/b", "/pic.jpg", "/x\ny", "//en/"]
    tails = ["", "?q=/en/", "#top", "?casino=1"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(400)]
    urls += [None, "", "no scheme", "a://b://c", "://", "http://" + "a" * 50_000 + ".com/"] + [urls[0]] * 50
    pages = spark.createDataFrame([(i, u, "k", True) for i, u in enumerate(urls)], "page_id long, url string, rule string, by_host boolean")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    got = {r.page_id: tuple(r)[1:] for r in url_verdicts(pages, rules).collect()}
    assert got == {i: slow_verdict(u) for i, u in enumerate(urls)}
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0)).collect()} == {"allow", "block"}
    assert url_verdicts(pages.limit(0), rules).collect() == []


def test_preference_pairs(spark):
    rng = random.Random(10)
    rows = {"chosen": [], "rejected": []}
    for conv in range(150):
        for side in rows:
            turns = [(conv, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for t in range(rng.randrange(0, 6))]
            rows[side] += turns + turns[:1]  # a repeated row
    extra = [(500, 0, None, None), (500, 0, "user", "a"), (500, None, "user", "z"), (None, 0, "user", "lost"), (501, 1, "assistant", "y" * 100_000)]
    rows["chosen"] += extra
    rows["rejected"] += extra
    schema = "conv_id long, turn long, role string, text string"
    chosen, rejected = (spark.createDataFrame(rows[s], schema).withColumn("side", F.lit(1)) for s in ("chosen", "rejected"))
    pairs = preference_pairs(chosen, rejected)
    columns = [c for s in ("chosen", "rejected") for c in (rendered(F.col(s)).alias(s), trained_chars(F.col(s)).alias(f"{s}_n"))]
    got = {r.conv_id: r for r in pairs.select("conv_id", "prompt_turns", "prompt", *columns).collect()}

    def turns_of(side):
        found = defaultdict(set)
        for conv, turn, role, text in rows[side]:
            if conv is not None:
                found[conv].add((turn is not None, turn or 0, role or "", text or ""))
        return {conv: [t[2:] for t in sorted(turns)] for conv, turns in found.items()}

    left, right = turns_of("chosen"), turns_of("rejected")
    assert set(got) == set(left) & set(right)
    show = lambda turns: "".join(f"<|{role}|>\n{text}\n" for role, text in turns)
    for conv, r in got.items():
        a, b = left[conv], right[conv]
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        assert r.chosen_n == sum(len(t) for role, t in a[n:] if role == "assistant")
        assert r.rejected_n == sum(len(t) for role, t in b[n:] if role == "assistant")
    assert preference_pairs(chosen.limit(0), rejected).collect() == []
    assert weaker(chosen).columns == ["conv_id", "turn", "role", "text"]
