"""Operators over all documents, against brute force on small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
from texts import WORDS, prose
from pyspark.sql import functions as F

from pataspark.llm import decontaminate, line_dedup, minhash, mixing, quality_rules, sharding


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    links = defaultdict(set)
    for a, s in sets:
        for b, t in sets:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                links[a].add(b)
    out = {}
    for d, _ in sets:
        seen, todo = {d}, [d]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[d] = min(seen)
    return out


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def test_near_duplicates_match_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows, n = [], 100
    for _ in range(6):
        base = prose(rng, rng.choice([6, 40, 150, 400]))
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.03, 0.04, 0.1):
            rows.append((n, edited(rng, base, share) if share else base))
            n += 1
    chain = prose(rng, 120).split()
    for k in range(12):  # each is like the next, the ends are not alike
        rows.append((n, " ".join(chain)))
        chain[k * 9: k * 9 + 2] = ["new", f"w{k}"]
        n += 1
    passage = prose(rng, 60)
    rows += [(n + i, prose(rng, 50) + "\n" + passage) for i in range(25)]
    rows += [(990, "a b"), (991, "A  b"), (992, "a b c"), (993, rows[0][1]), (993, rows[30][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd_docs.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = minhash.near_duplicates(docs).collect()
    want = plain_components(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((d or -1, len(shingles(t))) for d, t in rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_estimate_is_close(spark):
    rng, hashes = random.Random(9), minhash.WordHashes()
    base = prose(rng, 600)
    with np.errstate(over="ignore"):
        a = minhash.shingle_set(base, hashes)
        for share in (0.0, 0.01, 0.03):
            b = minhash.shingle_set(edited(rng, base, share), hashes)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same = np.mean((minhash.mix64(minhash._minima(a).astype(np.uint64)) & np.uint64(15)) == (minhash.mix64(minhash._minima(b).astype(np.uint64)) & np.uint64(15)))
            assert abs((same - 1 / 16) / (15 / 16) - true) < minhash.MARGIN


def test_large_bucket_makes_no_pairs_of_equal_texts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    got = minhash.near_duplicates(docs)
    assert got.filter("component_id <> 0").count() == 0 and got.filter("kept").count() == 1


def plain_dedup(rows):
    first, places = {}, defaultdict(set)
    filled = {d: [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for d, t in rows}
    for d in sorted(filled):
        f = filled[d]
        for k in range(len(f) - 2):
            w, lo, hi = tuple(x for _, x in f[k: k + 3]), f[k][0], f[k + 2][0]
            if w in first:
                a, b = (first[w][2] + 1, hi) if first[w][0] == d else (lo, hi)
                places[d] |= set(range(max(lo, a), b + 1))
            else:
                first[w] = (d, lo, hi)
    return {d: [i for i in range(len((t or "").split("\n"))) if i in places[d]] for d, t in rows}


def test_line_dedup_matches_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(10)
    rows = [(i, "\n".join(rng.choice(["a", "b", " a ", "", "c", "d" + str(rng.randint(0, 3))]) for _ in range(rng.randint(0, 14)))) for i in range(150)]
    rows += [(200, "x\nx\nx\nx\nx"), (201, "q\nx\nx\nx\nz")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_dedup(rows)
    for d, t in rows:
        assert got[d].removed == want[d]
        assert got[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])
    assert got[200].text == "x\nx\nx" and got[201].text == "q\nz"
    odd = line_dedup.dedup_lines(odd_docs)
    assert odd.count() == odd_docs.count() and odd.columns[: len(odd_docs.columns)] == [c for c in odd_docs.columns if c != "text"] + ["text"]
    assert {r.doc_id: r.text for r in odd.collect()}[6] == ""
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_tells_texts_of_one_id_apart(spark):
    def text(name, n=6):
        return "\n".join(f"{name} {i}" for i in range(n))
    known, own, other = text("known"), text("own"), text("other")
    rows = [(1, known, "a"), (None, known, "b"), (None, own, "c"), (7, known, "d"), (7, other, "e"), (7, other, "f"), (None, text("twice"), "g"), (None, text("twice"), "h")]
    got = {r.mark: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, mark string")).collect()}
    assert got["a"].text == known and got["b"].text == "" and got["d"].text == ""
    assert got["c"].text == own and got["e"].text == got["f"].text == other
    assert sorted([got["g"].text, got["h"].text]) == ["", text("twice")]


def plain_repeated(text):
    w = text.split()
    seen = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i: i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def test_quality_measures_match_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 80))
        if i % 3 == 0:
            t += "\n" + t[: len(t) // 2] + " #|$ end\n" + t
        rows.append((i, t, "h"))
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    for d, t, _ in rows:
        r, lines = got[d], [x for x in t.split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(t.split()), len("".join(t.split())), plain_repeated(t))
        assert (r.n_symbols, r.n_dup_lines) == (sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)))
    odd = quality_rules.quality_rules(odd_docs)
    assert odd.count() == odd_docs.count() and odd.columns.count("kept") == 1 and odd.filter("n_words is null or kept is null").count() == 0
    assert quality_rules.quality_rules(no_docs).count() == 0


def test_frequent_lines_of_a_host_go(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 60) + "\nAccept all 17 cookies", "h") for i in range(15)] + [(20, "accept  all 99 COOKIES\n" * 12 + "tail", "h")]
    rows += [(30 + i, "same copy of one text here " * 6, "h") for i in range(40)] + [(99, "Accept all 17 cookies " + prose(rng, 40), "g")]
    rows += [(30, "same copy of one text here " * 6, "h")] * 9  # repeated rows count once
    # In a large host a count above the limit decides alone, and 40 documents are not above it.
    rows += [(1000 + i, prose(rng, 30) + ("\nSubscribe to our letter" if i < 41 else "\nFollow us" if i < 81 else ""), "big") for i in range(900)]
    rows += [(3000 + i, prose(rng, 30) + ("\nA word from us" if i < 10 else ""), "small") for i in range(30)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0].n_frequent_lines == 1 and "cookies" not in got[0].clean_text and got[0].kept
    assert got[20].depleted and not got[20].kept and got[20].clean_text == "tail"
    assert got[30].n_frequent_lines == 1 and got[30].depleted and got[99].n_frequent_lines == 0  # 40 of 56 documents
    assert "Subscribe" not in got[1000].clean_text and got[1000].kept and "Follow" in got[1050].clean_text
    assert "A word" in got[3000].clean_text  # no more than ten


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= 3 * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    return target


def test_mix_meets_targets(spark, odd_docs, no_docs):
    rng = random.Random(13)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a"] * 12 + ["b", "c", "d", "é", None])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.planned_copies(docs).select("_row.*", "_size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in got:
        assert r.copies <= 3 and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source]
        taken[r.source] += r.copies * r._size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.03 * want[s] + 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.planned_copies(docs.repartition(7)).select("_row.*", "_size", "source_size", "target", "copies").collect()))
    assert mixing.planned_copies(odd_docs).count() == odd_docs.count() and mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mixed(no_docs).count() == 0


def test_hypergeometric_follows_its_law():
    from math import comb
    good, bad, drawn = 30, 50, 20
    rng = np.random.default_rng(14)
    seen = Counter(sharding.hypergeometric(good, bad, drawn, rng.random()) for _ in range(20_000))
    for k in range(drawn + 1):
        p = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn)
        assert abs(seen[k] / 20_000 - p) < 0.015
    big = sharding.hypergeometric(10**12, 10**12, 10**9, 0.5)
    assert abs(big - 5 * 10**8) < 10**5
    assert sharding.hypergeometric(5, 0, 3, 0.3) == 3 and sharding.hypergeometric(0, 5, 3, 0.3) == 0


def test_matrix_has_exact_margins():
    rows = [17, 0, 400, 3, 81]
    m = sharding.communication_matrix(rows, 24, 1)
    assert [sum(x) for x in m] == rows
    shards = [sum(c) for c in zip(*m, strict=True)]
    assert max(shards) - min(shards) <= 1


def test_shards_are_exact_and_gapless(spark, odd_docs, no_docs):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shuffled_into_shards(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 1000 and sorted(len(v) for v in by.values()) == [41] * 8 + [42] * 16
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shuffled_into_shards(docs.repartition(5)).collect()))
    near = sum(abs(a.shard - b.shard) <= 1 for a, b in zip(sorted(got), sorted(got)[1:]))
    assert near < 250  # neighbours are not kept together
    odd = sharding.shuffled_into_shards(odd_docs)
    assert odd.count() == odd_docs.count() and odd.columns.count("shard") == 1
    assert sharding.shuffled_into_shards(no_docs).count() == 0


def test_decontamination_finds_planted_passages(spark, odd_docs, no_docs):
    rng = random.Random(15)
    vocabulary = [a + b + c for a in WORDS[:20] for b in WORDS[20:40] for c in ("", "s")]
    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 60)) for _ in range(40)]
    rows, want = [], {}
    for i in range(120):
        words = text(rng.randint(0, 200))
        if i % 3 == 0:
            item = list(items[i % 40])
            if i % 2:
                for j in range(4, len(item), 5):  # every fifth word is another
                    item[j] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," for w in item]
            want[i] = i % 40
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit(1))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, " ".join(items[0])), (91, None), (None, "x " * 20), (92, "too short")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    for i, _ in rows:
        assert got[i].contaminated == (i in want)
        assert got[i].items == ([want[i]] if i in want else [])
    assert decontaminate.decontaminate(odd_docs, bench).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(no_docs, bench).count() == 0


def test_every_seed_hit_is_found(spark):
    """The Bloom filter loses nothing: hits equal those of comparing all seeds."""
    rng = random.Random(16)
    texts = [prose(rng, 40) for _ in range(10)]
    hashes = decontaminate.WordHashes()
    seeds = [decontaminate.spaced_seeds(hashes.array(w := decontaminate.word_bytes(t), len(w))) for t in texts]
    assert all(s.shape == (3, 30) for s in seeds)
    changed = texts[0].split()
    changed[3] = "changed"
    w = decontaminate.word_bytes(" ".join(changed))
    again = decontaminate.spaced_seeds(hashes.array(w, len(w)))
    assert again[0][0] == seeds[0][0][0] and again[1][0] != seeds[0][1][0]  # only the first mask passes over the fourth word
