"""Personal data, quality, language, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF, as_docs

from tallyline.llm import langid, pii, quality

# ------------------------------------------------------------ personal data

#: the base rules as they are stated, without the shortcuts of the operator
RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: max(map(int, s.split("."))) <= 255),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub(r"\D", "", s)) <= 19 and checks(re.sub(r"\D", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
]


def checks(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def brute_spans(text):
    return sorted((m.start(), i, m.end()) for i, (_, p, fits) in enumerate(RULES)
                  for m in re.finditer(p, text) if fits(m[0]))


@pytest.mark.parametrize("seed", range(30))
def test_base_spans(seed):
    rng = random.Random(seed)
    bits = ["a@b.co", "@", ".", "..", "+1 (555) 555-0100", "4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "999.1.1.1",
            "1.2.3.4.5.6.7.8", "x_y%z@h-h.org.uk", " ", "-", "é", "+", "12", "\n", "a" * 30, "0000000000000000000"]
    for _ in range(60):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+" * 200_000, "1 " * 100_000):
        pii.base_spans(text)
        pii.candidates(text)


def digests(df):
    out = {}
    for r in pii.find_in_documents(df).collect():
        out[r.doc_id] = r
    return out


def check_spans(got, texts):
    for i, text in texts.items():
        want = brute_spans(text or "")
        counts = Counter(k for _, k, _ in want)
        said = [f"{RULES[k][0]}:{a}:{b}" for a, k, b in want]
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",") if r.spans else [])


def test_spans_of_documents(docs, odd_docs, odd_texts, no_docs):
    check_spans(digests(docs), dict(docs.select("doc_id", "text").collect()))
    check_spans(digests(odd_docs), dict(enumerate(odd_texts)))
    assert pii.find_in_documents(no_docs).count() == 0


def test_trees_add_what_looks_valid_and_leave_the_rest(spark):
    rng = random.Random(1)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = []
    for i in range(1500):
        good = f"call +1 ({digit(3)}) 555-{digit(4)} now" if i % 2 else f"part {digit(3)}-{digit(4)}-{digit(4)}-{digit(9)} here"
        texts.append(f"some words {good} and more words {i}")
    texts.append("call (212) 555-1234 now")  # no plus sign
    texts.append("nothing to find here, 2024 items in 12 boxes")
    got = digests(as_docs(spark, texts))
    check_spans(got, dict(enumerate(texts)))
    assert got[1500].spans == "phone:5:19"
    assert got[1501].spans == ""
    clean = pii.redact(as_docs(spark, texts), None)
    assert clean.columns == as_docs(spark, texts).columns
    assert "<phone>" in clean.where("doc_id = 1").first().text


def test_thresholds_come_from_all_documents(spark):
    rng = random.Random(5)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"call +1 ({digit(3)}) 555-{digit(4)} now" if i % 50 == 0 else f"plain words {i}" for i in range(3000)]
    texts.append("call (212) 555-1234 now")
    df = as_docs(spark, texts)
    # a sample that holds about two of the sixty numbers
    model = pii.learn(df, training=100)
    phone = pii.KINDS.index("phone")
    assert np.isfinite(model.thresholds[phone]) and np.isinf(np.delete(model.thresholds, phone)).all()
    clean = pii.redact(df.where("doc_id = 3000"), model)
    assert clean.first().text == "call <phone> now"
    # none of them, and none at all
    assert np.isfinite(pii.learn(df, training=0).thresholds[phone])
    assert np.isinf(pii.learn(df.where("doc_id % 100 = 1")).thresholds).all()


def test_counted_candidates_are_all_but_those_trained_on(spark):
    text = " ".join(f"+1 (555) 555-{i:04}" for i in range(80))
    df = as_docs(spark, [text, text + " ", text, "none", None])
    trees = pii.Boosted()
    assert pii._held_back(df, trees, frozenset())[:, 3].sum(axis=1).tolist() == [240, 240]
    assert pii._held_back(df, trees, frozenset([pii._mark(text)]))[:, 3].sum(axis=1).tolist() == [80, 80]


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5)).round(1)
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 1)).astype(float)
    y[rng.random(4000) < 0.02] = 0
    model = pii.Boosted().fit(x[:2000], y[:2000])
    p = model(x[2000:])
    assert ((p > 0.5) == (y[2000:] > 0.5)).mean() > 0.97
    cut = pii.calibrate(p, y[2000:], np.zeros(2000, int), 0.95)
    assert y[2000:][p >= cut[0]].mean() >= 0.95 and np.isinf(cut[1:]).all()


def test_replacing_overlapping_spans():
    assert pii.replace("abcdef", [(1, 0, 4), (2, 1, 5)]) == "a<email>f"


# ------------------------------------------------------------------ quality


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    twice = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))


def check_quality(rows, texts):
    for r in rows:
        want = brute_measures(texts[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed) and 0 <= r.quality_probability <= 1


def test_quality_of_documents(docs, odd_docs, odd_texts, no_docs):
    check_quality(quality.judge(docs).collect(), dict(docs.select("doc_id", "text").collect()))
    check_quality(quality.judge(odd_docs).collect(), dict(enumerate(odd_texts)))
    assert quality.judge(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_measures(seed):
    import pyarrow as pa

    from tallyline.llm.common import flat
    rng = random.Random(seed)
    texts = ["".join(rng.choice(["a", "b b", " ", "\n", "\r", "é#", "|", "a b c a b c "]) for _ in range(rng.randrange(60)))
             for _ in range(20)]
    found = quality.measures(*flat(pa.array([*texts, None], pa.string())))
    for i, text in enumerate([*texts, ""]):
        assert tuple(int(found[c][i]) for c in quality._COUNTS) == brute_measures(text)


def test_votes_agree_with_labels(spark):
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    judged = [(v.quality, rows[v.doc_id].kept) for v in labels if not rows[v.doc_id].base_failed]
    assert np.mean([q == k for q, k in judged]) > 0.95


def test_estimating_rules():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((20_000, 4), int)
    for j, (hit, wrong) in enumerate([(0.9, 0.02), (0.7, 0.05), (0.8, 0.1), (0.0, 0.0)]):
        votes[~good & (rng.random(20_000) < hit), j] = quality.BAD
        votes[good & (rng.random(20_000) < wrong), j] = quality.BAD
    votes[good & (rng.random(20_000) < 0.9), 3] = quality.GOOD
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    odds, prior = quality.estimate(patterns, counts.astype(float))
    verdict = prior + odds[np.arange(4), votes].sum(axis=1) > 0
    assert (verdict == good).mean() > 0.97


# ----------------------------------------------------------------- language


def test_languages_that_were_not_seen(spark):
    df = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = langid.identify_documents(df).collect()
    lang = dict(df.select("doc_id", "lang").collect())
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_languages_of_odd_documents(odd_docs, odd_texts, no_docs, spark):
    rows = {r.doc_id: r for r in langid.identify_documents(odd_docs).collect()}
    for i, text in enumerate(odd_texts):
        lettered = any(c.isalpha() for c in text or "")
        assert rows[i].lang_pred == ("en" if lettered else "und")
    assert langid.identify_documents(no_docs).count() == 0
    mixed = spark.createDataFrame([(i, "abc def", v) for i, v in enumerate([None] * 9)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify_documents(mixed).collect()} == {"und"}


def test_labels_and_ids_are_no_inputs(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the and of", "der die das", "les des une"]) for _ in range(9)) for _ in range(300)]
    rows = [(i, t, "en" if "the" in t else "de" if "der" in t else "fr") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    a = [r.lang_pred for r in langid.identify(df.orderBy("doc_id").coalesce(1), model).collect()]
    b = [r.lang_pred for r in langid.identify(df.orderBy("doc_id").coalesce(1).drop("lang"), model).collect()]
    assert a == b


# ----------------------------------------------------------------- pipeline


def test_stages_keep_the_columns_and_take_effect(spark, odd_docs, tmp_path):
    import corpus_pipeline

    now, seen = odd_docs, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        now = spark.read.parquet(str(tmp_path / str(i)))
        seen.append((name, now))
        if i < 4:
            assert sorted(now.columns) == sorted(odd_docs.columns)
    named, unique, clean, mixed, packed = (x for _, x in seen)
    assert set(named.select("lang").distinct().collect()) == {("en",)}
    assert not any((r.text or "").strip() == "" for r in named.collect())
    assert unique.count() < named.count()
    assert not any("@x.example.com" in r.text for r in clean.collect())
    assert any("<email>" in r.text for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    import corpus_pipeline

    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
