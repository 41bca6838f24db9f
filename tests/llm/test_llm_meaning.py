"""Chat, licenses, personal data, toxicity and the pipeline."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
from llm_cases import DOC, documents, prose, words

from helixframe.llm import chat, license, pii, toxic
from pyspark.sql import Window, functions as F


def test_quotation_links(spark):
    talk = [
        (1, 0, "user", "Where is the blue house?\nI lost my way."),
        (1, 1, "assistant", "Near the old bridge.\nTurn left there."),
        (1, 2, "user", "> near the   OLD bridge.\nWhich bridge?"),
        (1, 3, "assistant", ">> Near the old bridge.\n> Which bridge?\n\nThe stone one."),
        (1, 4, "user", "> where is the blue house?\n> unknown words\nI found it."),
        (1, 5, "user", " > > Near the old bridge.\nOnly the second level is known."),
        (1, 6, "user", "no quote"),
        (2, 5, "user", "> Near the old bridge.\nOther conversation."),
        (2, 9, "system", None), (2, 9, "system", "twice"), (2, 10, None, ""),
        (None, 1, "user", "> x\ny"), (3, None, "user", "z"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("body", F.lit(1)).repartition(3)
    got = {(r.conv_id, r.turn): r for r in chat.quotation_links(df).collect()}
    pick = lambda k: (got[k].body, got[k].n_quoted, got[k].n_linked, got[k].max_level, got[k].reply_to, got[k].branch)
    assert pick((1, 0)) == ("Where is the blue house?\nI lost my way.", 0, 0, 0, None, 0)
    assert pick((1, 1))[4:] == (0, 0)
    assert pick((1, 2)) == ("Which bridge?", 1, 1, 1, 1, 0)
    assert pick((1, 3)) == ("The stone one.", 2, 2, 2, 2, 0)
    assert pick((1, 4)) == ("I found it.", 2, 1, 1, 0, 4)
    assert pick((1, 5)) == ("Only the second level is known.", 1, 1, 2, 1, 5)
    assert pick((1, 6))[4:] == (5, 5)
    assert pick((2, 5)) == ("Other conversation.", 1, 0, 1, None, 5)
    assert pick((2, 9)) == ("twice", 0, 0, 0, 5, 5)
    assert pick((2, 10))[4:] == (9, 5)
    assert pick((None, 1)) == ("y", 1, 0, 1, None, None)
    assert pick((3, None)) == ("z", 0, 0, 0, None, None)
    assert len(got) == 12
    assert chat.quotation_links(df.limit(0)).collect() == []


def test_quotation_links_one_long_conversation(spark):
    rng = random.Random(2)
    said, parent = [], {}
    for t in range(300):
        if t and rng.random() < 0.5:
            parent[t] = rng.randrange(t)
            said.append(f"> line {parent[t]}\nline {t}")
        else:
            parent[t] = t - 1 if t else None
            said.append(f"line {t}")
    df = spark.createDataFrame([(7, t, "user", x) for t, x in enumerate(said)], "conv_id long, turn long, role string, text string")
    seen, branch = set(), {}
    for t in range(300):
        p = parent[t]
        branch[t] = t if p is None or p in seen else branch[p]
        seen.add(p)
    got = {r.turn: (r.reply_to, r.branch, r.body) for r in chat.quotation_links(df).collect()}
    assert got == {t: (parent[t], branch[t], f"line {t}") for t in range(300)}


def test_quotations_wrapped_anew_or_in_part(spark):
    long = "the old stone bridge near the mill was closed last winter after the flood took away its middle arch and nobody knows when it opens again"
    w = long.split()
    wrapped = "\n".join("> " + " ".join(w[i:i + 9]) for i in range(0, len(w), 9))
    talk = [
        (1, 0, "user", long),
        (1, 1, "assistant", "Take the ferry then. It leaves at nine. Bring some\nmoney with you for the ticket."),
        (1, 2, "user", "nothing of note"),
        (1, 3, "assistant", wrapped + "\nAs you said."),                       # 26 words in three lines
        (1, 4, "user", "> It leaves at nine.\nToo late."),                     # a sentence of a longer line
        (1, 5, "user", "> bring SOME money\n>\n> with you\nHow much?"),        # other line breaks on both sides
        (1, 6, "user", "> closed last winter after the flood\nWhich flood?"),    # part of a line
        (1, 7, "user", ">> nobody knows when it opens\n> Which\n> flood?\nyes"),  # a passage for each level
        (1, 8, "user", "> closed last winter after the war\n> at nine\nnot said"),
        (1, 9, "user", "> It leaves at\nyes\n>\n> nine.\nsplit by own text"),
        (2, 1, "user", wrapped + "\nother conversation"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r.conv_id, r.turn): (r.n_quoted, r.n_linked, r.max_level, r.reply_to) for r in chat.quotation_links(df).collect()}
    assert got == {(1, 0): (0, 0, 0, None), (1, 1): (0, 0, 0, 0), (1, 2): (0, 0, 0, 1), (1, 3): (3, 3, 1, 0), (1, 4): (1, 1, 1, 1), (1, 5): (2, 2, 1, 1),
                   (1, 6): (1, 1, 1, 0), (1, 7): (3, 3, 2, 6), (1, 8): (2, 0, 1, 7), (1, 9): (2, 0, 1, 8), (2, 1): (3, 0, 1, None)}


LICENSE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def license_words(text):
    return LICENSE_WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_license_scan(spark):
    rng = random.Random(6)
    few = lambda n: " ".join(rng.choice("of the cc by nc general public license all rights reserved and terms in".split()) for _ in range(n))
    texts = [None, "", "CC-BY 4.0; cc  by cc by!", "General Public License, all rights reserved. All RIGHTS reserved", "CCé by", *[few(200) for _ in range(20)],
             "x " * 30 + "Licensed under the Apache License, Version 2.0." + " y" * 9,
             "Licensed under the very new Apache License, Version 2.0", "Released under the MIT License.",
             "licensed by apache the under license", prose(rng, 3000) + " This work is licensed under the GNU General Public License, version 3. " + prose(rng, 10)]
    got = {r.doc_id: r for r in license.summary(documents(spark, texts).withColumnRenamed("lang", "n_words")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = license_words(t)
        places = sorted((k, label) for p, label in license.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places)), i
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.score == 1 or not places
    n = len(texts)
    assert got[n - 5].labels == "apache-2.0" and got[n - 4].labels == "apache-2.0" and got[n - 3].labels == "mit"
    assert got[n - 2].labels == "" and got[n - 1].labels == "gpl,gpl-3.0"
    _, spans = license.scan(documents(spark, texts))
    assert [(r.start, r.end) for r in spans.where(F.col("doc_id") == n - 5).collect()] == [(30, 38)]


def test_changed_words_do_not_hide_a_notice(spark):
    """All that verification accepts reaches it, wherever the changed words stand."""
    rng = random.Random(8)
    texts, want = [], []
    for label, notice in license.NOTICES:
        w = notice.split()
        allowed = int((1 - license.VERIFIED) * len(w))
        for at in (list(range(1, len(w), 3))[:allowed], [0, len(w) - 1][:allowed], []):
            texts.append(prose(rng, 20) + " " + " ".join("zzz" if i in at else x for i, x in enumerate(w)) + " " + prose(rng, 20))
            want.append(label)
        at = list(range(0, len(w), 2))      # half of the words: never accepted
        texts.append(prose(rng, 20) + " " + " ".join("zzz" if i in at else x for i, x in enumerate(w)))
        want.append(None)
    texts.append("released under a mit license")
    want.append("mit")
    got = {r.doc_id: r.labels.split(",") for r in license.summary(documents(spark, texts)).collect()}
    for i, label in enumerate(want):
        assert label in got[i] if label else got[i] == [""], (texts[i], got[i])


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    checks = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    out = []
    for k, (pattern, good) in checks.items():
        out += [(m.start(), pii.KINDS.index(k), m.end(), k) for m in re.finditer(pattern, text or "") if good(m[0])]
    return sorted(out)


def pii_texts():
    rng = random.Random(13)
    alphabet = "0123456789" * 3 + "..--  ++@@ab_%()é\n"
    texts = [None, "", "a@b.c_d@e.f", "x@y", "a@b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.1.1 1.2.3.400", "4111 1111 1111 1111-2", "4111111111111111",
             "call +1 (555) 010-9999 now", "++1 234 567 8901", "\u0001a@b.c\u0002 \u0003", "é4111-1111-1111-1111é", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 300))) for _ in range(150)]
    return texts


def test_base_entities(spark):
    texts = pii_texts()
    got = {r.doc_id: r.spans for r in pii.spans(documents(spark, texts).withColumnRenamed("lang", "spans")).collect()}
    for i, t in enumerate(texts):
        base = [(s.start, s.kind, s.end) for s in got[i] if pii.KINDS[s.kind] != "id"]
        assert base == [x[:3] for x in base_spans(t)], (i, t)


def test_contexts_discover_and_redact(spark):
    rng = random.Random(1)
    texts = [f"{prose(rng, 20)} write to address user{i}@mail.example.com {prose(rng, 20)}" for i in range(9)]
    texts += [f"{prose(rng, 5)} write to address user-0{i}-4711 {prose(rng, 5)}" for i in range(3)]
    texts += ["see version id-2024-0001 of the text", "overlap 10.1.2.3@mail.example.com end"]
    docs = documents(spark, texts)
    got = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start:s.end]) for s in r.spans] for r in pii.spans(docs).collect()}
    assert all(got[i] == [("email", f"user{i}@mail.example.com")] for i in range(9))
    assert all(got[9 + i] == [("id", f"user-0{i}-4711")] for i in range(3))
    assert got[12] == []
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    out = {r.doc_id: r for r in clean.collect()}
    assert out[2].text == texts[2].replace("user2@mail.example.com", "[EMAIL]") and out[2].n_chars == len(out[2].text)
    assert out[10].text == texts[10].replace("user-01-4711", "[ID]")
    assert out[12].text == texts[12]
    assert "example" not in out[13].text and out[13].text.startswith("overlap [") and out[13].text.endswith("] end")


def test_discovered_identifiers_induce_contexts(spark):
    rng = random.Random(3)
    texts = [f"{prose(rng, 5)} please write to user{i}@mail.example.com {prose(rng, 5)}" for i in range(60)]
    texts += [f"{prose(rng, 5)} please write to staff-{i}-4711 {prose(rng, 5)}" for i in range(5)]
    texts += [f"{prose(rng, 5)} his badge number staff-{i}-4711 {prose(rng, 5)}" for i in range(5)]
    texts += [f"{prose(rng, 5)} his badge number staff-9-0815 {prose(rng, 5)}", f"{prose(rng, 5)} odd label staff-8-0815 {prose(rng, 5)}"]
    docs = documents(spark, texts)
    got = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start:s.end]) for s in r.spans] for r in pii.spans(docs).collect()}
    # no base entity stands after "badge number": the five identifiers of "write to" do
    assert all(got[65 + i] == [("id", f"staff-{i}-4711")] for i in range(5))
    assert got[70] == [("id", "staff-9-0815")] and got[71] == []
    found = pii.entities(docs)
    assert {r.context.strip() for r in pii.bootstrap(found, rounds=1).collect()} == {"write to"}
    assert {r.context.strip(): round(r.score, 3) for r in pii.bootstrap(found).collect()} == {"write to": 0.992, "badge number": 0.874}


def test_redaction_of_odd_rows(spark):
    rows = [(1, "a@b.cd", "en", "s", 6), (1, "a@b.cd", "en", "s", 6), (1, "other +1 555 010 99 99", "en", "s", 1), (None, "a@b.cd", None, None, None), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = sorted((str(r.doc_id), str(r.text)) for r in pii.redact(docs).collect())
    assert got == sorted([("1", "[EMAIL]"), ("1", "[EMAIL]"), ("1", "other [PHONE]"), ("None", "[EMAIL]"), ("2", "None")])
    assert pii.redact(docs.limit(0)).collect() == []


def test_entities_take_linear_time(spark):
    texts = ["a" * 400_000, "1" * 400_000, "1-" * 200_000, "1." * 200_000, "a1_" * 150_000, "+1 " * 150_000, "x@y." * 100_000]
    start = time.time()
    got = {r.doc_id: r.spans for r in pii.spans(documents(spark, texts)).collect()}
    assert len(got) == len(texts) and time.time() - start < 90


def toxic_case(spark):
    rng = random.Random(4)
    bad = ["grumblor", "snarfle", "wugh"]
    rows, labels = [], []
    for i in range(500):
        t = prose(rng, rng.randrange(20, 120), 900).split()
        y = i % 4 == 0
        if y:
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(bad)
        rows.append((i, " ".join(t), "en" if i % 3 else None, "s", 0))
        labels.append((i, 1, int(y)))
    rows += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "one", "xx", "s", 0), (903, prose(rng, 90_000, 900) + " snarfle", "en", "s", 0)]
    labels += [(5, 1, None), (None, 1, 1), (77_777, 0, 1), (4, 0, 1)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_case(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxic.fit(docs, labels.where(~held))
    keep = ["doc_id", "lang"]
    got = {r.doc_id: r.toxicity for r in toxic.score(docs, model, keep).collect()}
    out = {r.doc_id for r in docs.where(held).collect()}
    right = [(got[i].score >= 0.5) == (i % 4 == 0) for i in out if i < 500]
    assert len(right) > 60 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.flagged == (r.score >= r.threshold) for r in got.values())
    assert got[900].score == got[901].score < 0.5 and got[903].score >= 0.5
    # neither language nor row order changes a score; fitting again gives the same model
    other = {r.doc_id: r.toxicity.score for r in toxic.score(docs.withColumn("lang", F.lit("zz")).repartition(7), toxic.fit(docs.repartition(5), labels.where(~held)), keep).collect()}
    assert all(abs(other[i] - got[i].score) < 1e-6 for i in got)


def test_toxicity_without_labels(spark):
    docs, labels = toxic_case(spark)
    model = toxic.fit(docs, labels.limit(0))
    assert model is None
    assert {r.toxicity.score for r in toxic.score(docs, model, ["doc_id"]).collect()} == {0.0}


def test_filter_responses_in_chunks(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, n)) for n in (0, 1, 2, 3, 40, 200, 7)]
    rows, first = toxic.word_rows(pa.array(texts))
    m = toxic.Model(rng.normal(size=(toxic.ROWS, toxic.DIM)).astype(np.float32), [rng.normal(size=(w * toxic.DIM, toxic.FILTERS)).astype(np.float32) for w in toxic.WIDTHS],
                    [rng.normal(size=toxic.FILTERS).astype(np.float32) for _ in toxic.WIDTHS], np.zeros(25), 0.0)
    whole, _ = toxic.features(m, rows, first)
    monkeypatch.setattr(toxic, "CHUNK", 16)
    cut, _ = toxic.features(m, rows, first)
    assert np.allclose(whole, cut, atol=1e-4)
    for i, t in enumerate(texts):
        e = m.embedding[rows[first[i]:first[i + 1]]]
        for f, w in enumerate(toxic.WIDTHS):
            y = [max(0.0, *(float(v) for v in (np.concatenate(e[k:k + w]) @ m.filters[f] + m.bias[f])[[c]])) for c in range(toxic.FILTERS) for k in range(len(e) - w + 1)]
            n = max(len(e) - w + 1, 0)
            want = [max([0.0, *y[c * n:(c + 1) * n]]) for c in range(toxic.FILTERS)]
            assert np.allclose(whole[i, f * toxic.FILTERS:(f + 1) * toxic.FILTERS], want, atol=1e-3)


def test_tokens_are_discovered_behind_signs(spark):
    """Keys behind ``token = "`` are found, other values at that place too; numbers
    in prose are not. The values are counted by a regular expression of the test."""
    rng = random.Random(12)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f'{prose(rng, 8)}. {prose(rng, 3)} {rng.choice(["token", "TOKEN"])} = "{key()}" {prose(rng, 6)}' for _ in range(30)]
    texts += [f'{prose(rng, 8)} token = "AB-2024-XY-77" {prose(rng, 6)}', f'{prose(rng, 4)} "4111 1111 1111 1112" {prose(rng, 4)}']
    texts += [f"{prose(rng, 9)} {rng.randrange(10**15, 10**16)} {prose(rng, 9)}" for _ in range(40)] + [key() for _ in range(2)]
    docs = documents(spark, texts)
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans if pii.KINDS[s.kind] == "id"] for r in pii.spans(docs).collect()}
    want = {i: [m.group(1)] for i, t in enumerate(texts) if (m := re.search('(?i)token = "([^"]+)"', t))}
    assert {i: v for i, v in got.items() if v} == want and len(want) == 31


def test_redaction_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "to a@b.co now", 1, 2, 3, 4, 5)], "doc_id long, text string, _text int, _heads int, _end int, _doc int, id int")
    out = pii.redact(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "to [EMAIL] now", 1, 2, 3, 4, 5)]


def test_toxicity_learns_from_every_labelled_document(spark):
    """A word that only stands in toxic documents late in the order of hashes."""
    ids = spark.range(4400).select("id", F.row_number().over(Window.partitionBy(F.col("id") % 2).orderBy(F.xxhash64("id"))).alias("r"))
    late = F.when(F.col("r") > 1500, "zorkmid").otherwise("grumblor")
    text = F.concat_ws(" ", F.lit("it was a"), F.concat(F.lit("w"), F.col("id") % 97), F.when(F.col("id") % 2 == 1, late).otherwise("plain"), F.concat(F.lit("x"), F.col("id") % 89))
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    labels = ids.select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    model = toxic.fit(docs, labels)
    new = spark.createDataFrame([(1, "it was a zorkmid x3", "en"), (2, "it was a plain x3", "en"), (3, "it was a grumblor x3", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.toxicity.score for r in toxic.score(new, model, ["doc_id"]).collect()}
    assert got[1] >= 0.5 and got[3] >= 0.5 and got[2] < 0.5


def test_toxicity_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(toxic, "SHARD_WORDS", 5000)
    docs, labels = toxic_case(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = [{r.doc_id: r.toxicity.score for r in toxic.score(docs, toxic.fit(d, labels.where(~held)), ["doc_id"]).collect()} for d in (docs, docs.repartition(5))]
    out = {r.doc_id for r in docs.where(held & (F.col("doc_id") < 500)).collect()}
    assert np.mean([(got[0][i] >= 0.5) == (i % 4 == 0) for i in out]) >= 0.95
    assert got[0] == got[1]
