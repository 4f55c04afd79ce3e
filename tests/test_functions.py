"""Functions against known values and brute force."""

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.functions import judging, numeric, text, vector


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_random_stream_is_the_sequential_one(spark):
    want = [u for u, _ in zip(numeric.uniforms(42), range(500))]
    got = [r[0] for r in spark.range(500).select(numeric.uniform(F.col("id"), 42)).orderBy("id").collect()]
    assert got == want
    assert len(set(u for u, _ in zip(numeric.uniforms(11), range(200_000)))) > 199_000


def test_rounding_and_tail(spark):
    assert [one(spark, numeric.round_half_up(F.lit(x))) for x in (-0.5, 0.5, 1.4, -1.6)] == [0, 1, 1, -2]
    assert one(spark, numeric.strict_from_tail(F.lit(0.5), F.lit(0.6), F.lit(0.1))) == pytest.approx(0.5 - 0.1 * math.log(10) / math.log(5))
    assert one(spark, numeric.strict_from_tail(F.lit(0.5), F.lit(0.6), F.lit(0.45))) == 0.45


def test_tokens_and_styles(spark):
    assert one(spark, text.tokens(F.lit("Été, x_1 — 東京!"))) == ["été", "x_1", "東京"]
    assert one(spark, text.bigrams(F.lit("abc 東京都 京"))) == ["abc", "東京", "京都", "京"]
    assert one(spark, text.without(["the"])(F.lit("The cat"))) == ["cat"]
    styles = {"one two three four": "short", "one two three four five": "question", "why?": "question", "東京都の人口は何人ですか": "question", "東京": "short", "": "short", None: None}
    for q, want in styles.items():
        assert one(spark, text.query_style(F.lit(q).cast("string"))) == want


def test_names(spark):
    assert one(spark, text.section_path(F.lit("A > B > C"))) == "B › C"
    assert one(spark, text.section_path(F.lit("A"))) == ""
    assert one(spark, text.domain(F.lit("law.tax"))) == "law" and one(spark, text.domain(F.lit("law"))) == "la"
    assert one(spark, text.lang_of(F.lit("set-zh"))) == "zh" and one(spark, text.lang_of(F.lit("set"))) == "set"
    run = one(spark, text.parse_run(F.lit("here:a:b/c+raw"), ["here"]))
    assert (run.backend, run.model, run.raw) == ("here", "a:b/c", True)
    assert one(spark, text.parse_run(F.lit("else:a"), ["here"])) is None
    assert one(spark, text.run_key(F.lit("here"), F.lit("b/c"), F.lit(True))) == "here/b_c+raw"
    assert one(spark, text.page_link(F.lit("12#3"))).endswith("=12") and one(spark, text.page_link(F.lit("a#3"))) is None
    assert one(spark, text.dev_query_id(F.lit("en"), F.lit("dev_query7"))) == "en-7"


def test_durations(spark):
    for s, ms in {"1m2s": 62_000, "250ms": 250, "1.5": 1500, "1h": 3_600_000, "soon": 1000}.items():
        assert one(spark, text.duration_ms(F.lit(s))) == ms


def test_snippets(spark):
    source = "# Head\n| a | b |\n> quote\nSee [the page](http://x) and *bold* `code` --- end."
    assert one(spark, text.snippet(F.lit(source))) == "See the page and bold code end."
    assert one(spark, text.snippet(F.lit("# only head"))) == "only head"
    long = "word " * 60
    assert one(spark, text.excerpt(F.lit(long))) == (long[:159].rstrip()) + "…" and one(spark, text.excerpt(F.lit("short"))) == "short"
    assert len(one(spark, text.excerpt(F.lit("x" * 300)))) == 141
    assert one(spark, text.script(F.lit("國这"))) == "simplified" and one(spark, text.script(F.lit("國這"))) == "traditional"
    assert one(spark, text.without_nul(F.lit("a\0b"))) == "ab"
    assert one(spark, text.matched_words(F.lit("Why Cats why"), F.lit("cats know WHY"))) == ["Why", "Cats", "why"]
    assert one(spark, text.plain_question(F.lit("What is it"))) is True and one(spark, text.plain_question(F.lit("What are 3"))) is False
    assert one(spark, text.gated(F.lit("ab"), "a", "c")) == "ab" and one(spark, text.gated(F.lit("ac"), "a", "c")) == ""
    assert one(spark, text.signed_interval(F.lit(0.012), F.lit(-0.003), F.lit(0.02))) == "+1.2 [-0.3, 2.0]"
    assert one(spark, text.as_ms(F.lit(1500.0))) == "1.5 s" and one(spark, text.as_percent(F.lit(0.5))) == "50.0%"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vector.dot(a, b)) == 24 and one(spark, vector.norm(a)) == 5
    assert one(spark, vector.unit(a)) == [0.6, 0.8] and one(spark, vector.unit(F.array(F.lit(0.0)))) == [0.0]
    assert one(spark, vector.cosine_distance(a, b)) == pytest.approx(0.04) and one(spark, vector.cosine_distance(a, F.array(F.lit(0.0), F.lit(0.0)))) is None
    for bad in (F.array(F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(float("nan")), F.lit(1.0)), F.array(F.lit(None).cast("double"), F.lit(1.0)), F.lit(None).cast("array<double>")):
        assert one(spark, vector.usable(bad, 2)) is False
    assert one(spark, vector.usable(a, 2)) is True


def test_reading_scores():
    """Answers built at random, in all forms, give back the scores they were built from."""
    rng = random.Random(12)
    for _ in range(200):
        n = rng.randrange(1, 9)
        given = {i: rng.choice([rng.randrange(-3, 15), rng.random() * 12]) for i in rng.sample(range(n), rng.randrange(1, n + 1))}
        clamped = [float(min(10, max(0, given.get(i, 0)))) for i in range(n)]
        items = [{"i": rng.choice([i, str(i), float(i)]), "score": rng.choice([x, f" {x} "]), "why": "-"} for i, x in given.items()]
        items += rng.sample([{"i": n, "score": 1}, {"i": 0.5, "score": 1}, {"score": 4}, 17, None, {"i": 0, "score": "high"}, {"i": -1, "score": 2}], rng.randrange(4))
        rng.shuffle(items)
        text = rng.choice(["", "Here it is:\n", "~~~\n"]) + json.dumps(items) + rng.choice(["", "\nDone.", "\n~~~"])
        assert judging.parse_scores(text, n) == pytest.approx(clamped)
        assert judging.scored_count(text, n) == len(given)
        assert judging.parse_scores(text[: text.rindex("]")], n) is None
        good = {i: round(abs(x), 3) for i, x in given.items()}
        want = [float(min(10, good.get(i, 0))) for i in range(n)] if 2 * len(good) >= n else None
        lines = "\n".join(rng.choice(["[{}] {}", " [{}]: {}", "[{}] - {} "]).format(i, x) for i, x in good.items())
        objects = " and ".join(f'{{ "i": {i}, "score":{x}}}' for i, x in good.items())
        assert judging.stated_scores(lines, n) == want and judging.stated_scores(objects, n) == want
        assert judging.scored_count("Sure.\n" + lines, n) == (len(good) if want else 0)


def test_answers_that_hold_no_scores():
    for text in ("", "none", "[", "]", "[]", "[1, 2]", '[{"i": 0, "score": NaN}]', '[{"i": 0, "score": 4}, {"i": 1, "score": Infinity}]', '[{"i": 0, "score": "٣"}]'):
        assert judging.parse_scores(text, 3) is None
        assert judging.scored_count(text, 9) == 0
    assert judging.parse_scores('[{"i": 1, "score": 2}, {"i": 1, "score": 6}]', 2) == [0, 6]
    assert judging.stated_scores("[1] 2\n[1] 6", 2) == [0, 2]


def test_yes_no_question(spark):
    asked = json.loads(spark.range(1).select(judging.yes_no_question(F.lit("p7"))).first()[0])
    assert asked["instructions"] == "Does passage p7 help answer the query?" and set(asked["criteria"]) == {"true", "false"} and asked["type"] == "noul"


def test_answers_in_a_column(spark):
    df = spark.createDataFrame([(1, '[{"i":0,"score":3}]', 2, None), (2, "[0] 4\n[1] 5", 2, None), (3, "[0] 4\n[1] 5", 2, "length"), (4, None, 2, None), (5, "x", None, None)], "k int, raw string, n int, stop string")
    got = {r.k: r.r for r in df.select("k", judging.read_answer("raw", "n", "stop").alias("r")).collect()}
    assert got[1].scores == [3, 0] and got[2].scores == [4, 5] and got[3].scores is None and got[3].scored == 2
    assert got[4].scores is None and got[5].scores is None


def test_terms():
    assert judging.terms_of("Ab 東京都x 7 c") == [("ab", 0), ("東京", 3), ("京都", 4), ("7", 8)]
    assert judging.terms_of("🧭 ab 東") == [("ab", 3), ("東", 6)]


def test_excerpts():
    filler = "Nothing here to see at all. " * 60
    text_ = filler + "The zebra crossing is striped. " + filler
    cut = judging.excerpts("zebra striped", [text_, "short text", filler], 300)
    assert cut[0].startswith("… The zebra") and len(cut[0]) <= 302 and cut[1] == "short text" and cut[2] == filler[:300].strip()
    assert judging.excerpts("zebra", ["zebra " + filler], 100)[0].startswith("zebra")
    rng = random.Random(0)
    for _ in range(50):
        body = "".join(rng.choice("ab .\n東京") for _ in range(rng.randrange(0, 400)))
        out = judging.excerpts("a 東京 ab", [body, "b"], 50)[0]
        assert out.removeprefix("… ") in body and len(out) <= 52


def test_excerpts_are_the_heaviest_windows():
    """Against brute force over every start: no window holds more weight, and none that does as well starts earlier, but for
    an opening moved back to a line or sentence start."""
    rng = random.Random(5)
    for _ in range(60):
        texts = [" ".join(rng.choice(["pine", "oak", "elm", "ash", "moss.", "fern", "x\n", "one two three four"]) for _ in range(rng.randrange(5, 70))) for _ in range(3)]
        query, chars = "oak elm ash", 40
        terms = [[(t, at) for t, at in judging.terms_of(x) if t in query.split()] for x in texts]
        weight = {t: math.log(1 + (3 - df + 0.5) / (df + 0.5)) for t in query.split() for df in [sum(any(u == t for u, _ in ts) for ts in terms)]}
        for x, ts, out in zip(texts, terms, judging.excerpts(query, texts, chars)):
            if len(x) <= chars:
                assert out == x.strip()
                continue
            held = [sum(weight[t] for t in {t for t, at in ts if s <= at < s + chars}) for s in range(len(x))]
            first = next((s for s in range(len(x)) if (s == 0 or any(at == s for _, at in ts)) and held[s] >= max(held) - 1e-9), 0)
            starts = [s for s in range(max(0, first - chars // 5), first + 1) if out == ("… " if s else "") + x[s : s + chars].strip()]
            assert any(held[s] >= max(held) - 1e-9 for s in starts)


def test_excerpts_per_question(spark):
    pdf = pd.DataFrame({"question": ["q", "q", "r"], "query": ["zebra", "zebra", None], "pos": [2, 1, 1], "text": ["x " * 900 + "zebra", "no", None]})
    out = {(r.question, r.pos): r.excerpt for r in judging.excerpt_candidates(spark.createDataFrame(pdf)).collect()}
    assert out[("q", 2)].startswith("… ") and out[("q", 1)] == "no" and out[("r", 1)] == ""


def test_profiles(spark):
    rules = [("^big", 2), ("g", 1)]
    assert [one(spark, text.first_match(F.lit(x), rules, 0)) for x in ("big", "gig", "x")] == [2, 1, 0]
    some = F.array(F.lit(3072), F.lit(768), F.lit(256))
    assert one(spark, text.fitting_width(F.lit(3072), some)) == 768 and one(spark, text.fitting_width(F.lit(768), some)) is None
    assert one(spark, text.fitting_width(F.lit(3072), F.lit(None).cast("array<int>"))) == 1024
