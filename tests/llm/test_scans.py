"""Operators that look at one text at a time, against plain versions of their rules."""

import random
import re
import time
import zlib

import numpy as np
import pytest

from pataspark.llm import licenses, secrets, tokens, toxicity


def plain_secrets(text):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if m.end() - m.start() >= 20:
            spans.append((m.start(), 1, m.end(), "access"))
    for m in re.finditer("[0-9a-f]+", text):
        if m.end() - m.start() >= 24:
            spans.append((m.start(), 2, m.end(), "hex"))
    return [(k, s, e) for s, _, e, k in sorted(spans)]


def test_base_secrets_match_plain_version():
    rng = random.Random(1)
    parts = ["password", "Token", "API_KEY", "apikey", "secret", "=", ": ", '"', "'", "abcdef12", "x", " ", "\n", "AKIA", "Z9" * 9, "0a" * 12, "é", "ſecret", "a=b"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_lexer_follows_constants_and_leaves_prose():
    text = 'salt = "Xk29dLq0zPwM"\ndb_password = salt + "77aaQQ"\nKey to success: work hard.\npwd: str = "hunter2hunter2X"\nname = "Zk29dLq0zPwM"\n'
    found = [text[s:e] for k, s, e in secrets.literal_spans(text)]
    assert found == ["Xk29dLq0zPwM", "77aaQQ", "hunter2hunter2X"]
    for clean in ("The token economy: a study of secrets.", "password = os.getenv('PW')", 'public_key = "Zk29dLq0zPwM"', 'password = "changeme"'):
        assert secrets.literal_spans(clean) == []


@pytest.mark.parametrize(("text", "want"), [
    ("API_KEY_X = (\n  'Xk29dLq0zPwM'\n)", ["Xk29dLq0zPwM"]),
    ("client_pwd = 'Xk29dLq0' +\n  'zPwM77aa'\nx = 1", ["Xk29dLq0", "zPwM77aa"]),
    ("client_pwd = 'Xk29dLq0' \\\n  + 'zPwM77aa'", ["Xk29dLq0", "zPwM77aa"]),
    ("client_pwd = ('Xk29dLq0'\n  'zPwM77aa')", ["Xk29dLq0", "zPwM77aa"]),
    ('{"client_pwd":\n  "Xk29dLq0zPwM",\n "a":\n "b"}', ["Xk29dLq0zPwM"]),
    ("client_pwd:\n  Xk29dLq0zPwM\nuser: bob", ["Xk29dLq0zPwM"]),
    ('client_pwd = """\nXk29dLq0\nzPwM77aa\n"""', ["Xk29dLq0\nzPwM77aa"]),
    ("encryption = 'Xk29dLq0zPwM'", ["Xk29dLq0zPwM"]),
    ("jwt = '" + "Xk29dLq0zPwM" * 400 + "'", ["Xk29dLq0zPwM" * 400]),
    ("block {\n  client_pwd = 'Xk29dLq0zPwM'\n  user = 'bob'\n}", ["Xk29dLq0zPwM"]),
    ("auth:\n  user: bobby9X\n  pwd: Xk29dLq0zPwM", ["Xk29dLq0zPwM"]),
    ("+client_pwd = 'Xk29dLq0zPwM'\n+other = 'Zk29dLq0zPwM'", ["Xk29dLq0zPwM"]),
])
def test_lexer_follows_values_over_lines(text, want):
    assert [text[s:e] for _, s, e in secrets.literal_spans(text)] == want


def test_every_sensitive_name_passes_the_gate():
    for name in secrets.SENSITIVE:
        assert any(h in name for h in secrets._HINTS)
        assert secrets.literal_spans(f"{name} = 'Xk29dLq0zPwM#Yt71'"), name


def _chains():
    rng = random.Random(3)
    def piece():
        return "".join(rng.choice("abcdefghijkABCDEFGH0123456789") for _ in range(20))
    yield "secret_key = 'q9'\n" + "".join(f"secret_key = secret_key + '{piece()}'\n" for _ in range(20_000)), 20_001
    yield "k0 = 'aZ9$kqLm2'\n" + "".join(f"k{i + 1} = k{i} + '{i}'\n" for i in range(40_000)) + "password = k40000\n", 40_001
    yield "a = 'aZ9$kqLm2'\n" + "a = a + a\n" * 80_000 + "client_pwd = a\n", 1
    yield "{" + ",".join(f"secret{i}:b{i}" for i in range(60_000)) + "}", 0
    yield "secret:" + ":".join(["ab"] * 300_000) + ",", 0
    yield "secret=" + '"\\' * 400_000, 0


@pytest.mark.parametrize(("text", "n_literals"), list(_chains()), ids=["own name", "names", "doubled", "one line", "colons", "escapes"])
def test_long_texts_take_linear_time(text, n_literals):
    start = time.process_time()
    assert len(secrets.literal_spans(text)) == n_literals
    assert time.process_time() - start < 20 * max(1, len(text) / 1e6)  # 2 to 5 s alone; hours if the work grew with the square


def test_joined_values_are_scored_like_their_text():
    rng = random.Random(4)
    for _ in range(3000):
        parts = ["".join(rng.choice("abXY01xX*-_ <>{}%$é") if rng.random() < 0.5 else "x" for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        whole = secrets.Profile.of(parts[0])
        for p in parts[1:]:
            whole += secrets.Profile.of(p)
        assert whole.score() == pytest.approx(secrets.literal_score("".join(parts)))
    for value in ("x" * 40, "X" * 20 + "x" * 20, "your-" + "k9Zq" * 9, "<" + "k9Zq" * 9 + ">", "${" + "k9Zq" * 9 + "}", "insert" + "k9Zq" * 9):
        assert secrets.PLACEHOLDER.match(value) and secrets.literal_score(value) == 0.0
    assert secrets.literal_score("x" * 20 + "k9Zq" * 9) > 0.3


def test_all_base_spans_stay():
    text = 'password = "Xk29dLq0zPwM"\nclient_pwd = "Ak29dLq0zPwM"'
    base, spans = secrets.all_spans(text)
    assert set(base) <= set(spans) and len(spans) == 2
    assert secrets.redacted(text).count("[secret]") == 2


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(label, i) for i in range(len(words) - len(p) + 1) if words[i: i + len(p)] == p]
    return len(words), sorted(found)


def test_license_base_matches_plain_version():
    rng, book = random.Random(2), licenses.RuleBook()
    parts = ["GNU", "General", "public", "license", "Apache", "CC", "BY", "MIT", "cc-by", "x", "é", "9", "mit license"]
    for _ in range(2000):
        text = rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        n, base, _ = licenses.detect(text, book)
        assert (n, sorted(base)) == plain_licenses(text)


def test_license_rules_rank_and_suppress():
    assert len(licenses.rules()) > 200
    found = licenses.detect("Licensed under the Apache License, Version 2.0; see also CC-BY-SA and all rights reserved.")[2]
    assert [d.label for d in found] == ["apache-2.0", "cc-by-sa-4.0", "proprietary"]
    assert licenses.detect("The permission of the author is reserved for gnu farmers.")[2] == []


def test_short_identifiers_count_in_statements_only():
    book = licenses.RuleBook()

    def labels(text):
        return [d.label for d in licenses.detect(text, book)[2]]
    for label in licenses.NAMES.keys() | licenses.SHORT.keys():
        for name in licenses.NAMES.get(label, ()) + licenses.SHORT.get(label, ()):
            assert label in labels(f"// SPDX-License-Identifier: {name}"), name
    for label, name in (("mit", "MIT"), ("isc", "ISC"), ("zlib", "Zlib"), ("artistic-2.0", "Artistic-2.0"), ("gpl-2.0", "GPL-2.0-or-later"), ("cc-by-sa-4.0", "CC-BY-SA-4.0"), ("bsd", "BSD"), ("boost-1.0", "BSL-1.0")):
        for form in ("SPDX-License-Identifier: {}", "Licensed under {}.", "released under the {} license", '"license": "{}",'):
            assert labels(form.format(name)) == [label], (form, name)
    for text in ("She studied at MIT.", "the apache helicopter", "a boost of zlib speed", "license is granted to gpl readers"):
        assert labels(text) == []


def plain_suppressed(found):
    kept = []
    for d in sorted(found, key=lambda d: (d.rank, d.first, -d.last)):
        if not any(k.first <= d.first and d.last <= k.last for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.first, d.last, d.rank))


def test_suppression_matches_plain_version():
    rng = random.Random(3)
    for _ in range(500):
        found = [licenses.Detection("x", a := rng.randint(0, 20), a + rng.randint(0, 8), 1.0, rng.randint(0, 6)) for _ in range(rng.randint(0, 14))]
        assert licenses.suppressed(found) == plain_suppressed(found)


def test_every_rule_matches_its_own_name():
    keys = licenses.rules()
    for r in keys[len(licenses.SENTENCES):]:
        assert r.keyword in r.expression.split(b"(?<= )")[1]


@pytest.mark.parametrize("lengths", [[], [1], [0, 0, 5], [3] * 200, [1, 100_000, 1, 1], list(range(300))])
def test_block_round_trip(lengths):
    rng = np.random.default_rng(4)
    lengths = np.array(lengths, np.uint64)
    ids = rng.integers(0, 70_000 if len(lengths) == 1 else 49_000, int(lengths.sum()), dtype=np.uint32)
    block = tokens.Block(tokens.write_block(lengths, ids))
    ends = np.cumsum(lengths).astype(np.int64)
    assert block.ends().tolist() == ends.tolist() == [block.end(i) for i in range(len(ends))]
    assert block.ids.tolist() == ids.tolist()
    for i in range(0, len(ends), 7):
        assert block.document(i).tolist() == ids[ends[i] - int(lengths[i]): ends[i]].tolist()


def test_boundaries_take_little_space():
    lengths = np.full(10_000, 500, np.uint64)
    data = tokens.write_block(lengths, np.zeros(int(lengths.sum()), np.uint32))
    assert len(data) - 2 * int(lengths.sum()) < 10_000 * 2


def test_token_ids_equal_whole_texts(spark, odd_docs, no_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    more = spark.createDataFrame([(20, "it's <|endoftext|> don't  A b́ ẛ̣ x\r\ny z 12,5"), (-4, "é ́a\ńb")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    blocks = tokens.write_tokens(docs, path, block_ids=5_000)
    got = tokens.read_tokens(blocks).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = whole.encode(r.text or "", add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokens.read_tokens(tokens.write_tokens(no_docs, path)).count() == 0


def toxic_rows(n=600, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice(["ba", "ce", "dilo", "fonta", "guvan", "hark", "lemis"]) for _ in range(9)) for _ in range(rng.randint(1, 12))]
        y = i % 5 == 0
        if y:
            lines[rng.randrange(len(lines))] += " you vexlor" + rng.choice(["", "an", "ig", "eb"])
        rows.append((". ".join(lines), int(y)))
    return rows


def test_toxicity_learns_from_documents_and_locates_sentences(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model == toxicity.train(docs.repartition(3), labels.repartition(5))
    scores = toxicity._Scores(model)
    right = 0
    for text, y in toxic_rows(200, 7):
        p = toxicity.noisy_or(toxicity._logits(toxicity.sentences(text), model, scores))
        right += (p >= 0.5) == bool(y)
        for a, b, _ in toxicity.offending(text, model):
            assert "vexlor" in text[a:b]
    assert right >= 196


def test_held_out_accuracy_on_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert len(got) > 50 and sum(r.predicted == r.toxic for r in got) >= 0.9 * len(got)  # some labels there are wrong on purpose


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "vexlor here. " if i % 2 else "calm words. ", i % 2) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.train(df, df).weights == {}


def test_toxicity_of_one_class_and_of_nothing():
    assert toxicity.fit_weights([], {}).weights == {} and toxicity.fit_weights([(0, 3, [])], {}).bias < 0
    assert toxicity.fit_weights([(1, 3, [])], {}).bias > 0
    assert toxicity.noisy_or(np.empty(0)) == 0.0


def test_scans_take_odd_tables(spark, odd_docs, no_docs):
    n = odd_docs.count()
    for scan in (secrets.scan_secrets, licenses.scan_licenses):
        assert scan(odd_docs).count() == n and scan(no_docs).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    scored = toxicity.scored(odd_docs, toxicity.train(odd_docs, labels))
    assert scored.count() == n and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert scored.columns.count("score") == 1 and "node" in scored.columns
    assert toxicity.scored(no_docs, toxicity.train(no_docs, labels.limit(0))).count() == 0
