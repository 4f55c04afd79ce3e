"""Text as column expressions; what needs scanning with state is in ``judging``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
# Common characters that the two scripts write differently, pairwise.
TRADITIONAL = "國這說為們時會來對學與個體發過還後們經從當實現關機說開長門問間點爲氣樣種處車東認語讓書邊頭將員場區應總數變動進產業義務項標記號歷設計"
SIMPLIFIED = "国这说为们时会来对学与个体发过还后经从当实现关机开长门问间点气样种处车东认语让书边头将员场区应总数变动进产业义务项标记号历设计"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def bigrams(text: Column) -> Column:
    """For scripts without spaces: tokens, those of wide scripts cut to character pairs."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    return F.flatten(F.transform(tokens(text), lambda t: F.when(t.rlike(_UNSPACED), pairs(t)).otherwise(F.array(t))))


def without(stop: list[str], base: Tokenizer = tokens) -> Tokenizer:
    """A tokenizer that drops the given words."""
    return lambda text: F.filter(base(text), lambda t: ~t.isin(stop))


def seen_from_start(text: Column, chars: int = 1200) -> Column:
    return F.trim(F.substring(text, 1, chars))


def document_text(title: Column, section: Column, text: Column) -> Column:
    """``title — section`` above the text; a missing or empty title is "Untitled", a missing section is left out."""
    head = F.when(F.coalesce(title, F.lit("")) == "", F.lit("Untitled")).otherwise(title)
    return F.concat(F.when(F.coalesce(section, F.lit("")) == "", head).otherwise(F.concat(head, F.lit(" — "), section)), F.lit("\n"), F.coalesce(text, F.lit("")))


def titled_text(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) == "", text).otherwise(F.concat(title, F.lit("\n\n"), text))


def query_style(query: Column) -> Column:
    """"question" with a question mark, more than four words, or more than eight characters of an unspaced script; else
    "short"."""
    t = F.regexp_replace(query, r"^[\s 　]+|[\s 　]+$", "")
    words = F.size(F.filter(F.split(t, r"[\s 　]+"), lambda w: w != ""))
    bare = F.regexp_replace(t, r"[\s 　]+", "")
    question = t.rlike("[?？]") | (words > 4) | (t.rlike(_UNSPACED) & (F.length(bare) > 8))
    return F.when(t.isNull(), F.lit(None).cast("string")).when(question, "question").otherwise("short")


def cutoff_for(query: Column, short: Column, question: Column) -> Column:
    """The distance in force for a query's style; null where none is."""
    return F.when(query_style(query) == "short", short).otherwise(question)


def script(text: Column) -> Column:
    """"traditional" if more characters are of that script than of the simplified one."""
    count = lambda letters: F.length(text) - F.length(F.translate(text, letters, ""))
    return F.when(count(TRADITIONAL) > count(SIMPLIFIED), "traditional").when(text.isNotNull(), "simplified")


def snippet(text: Column, chars: int = 180) -> Column:
    """Opening prose: lines that aren't headings, tables or quotes, links as their text, markup taken out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    prose = F.filter(lines, lambda x: ~x.rlike(r"^\s*(#|\||>|:::)"))
    body = F.array_join(F.when(F.size(prose) > 0, prose).otherwise(lines), " ")
    for pattern, by in ((r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"\\", ""), (r"[*_`#|]", ""), (r"-{3,}", ""), (r"\s+", " ")):
        body = F.regexp_replace(body, pattern, by)
    return F.substring(F.trim(body), 1, chars)


def excerpt(text: Column, most: int = 160) -> Column:
    """At most ``most`` characters, cut at the last space of the final twenty if there is one, then an ellipsis."""
    cut = F.substring(text, 1, most)
    back = F.locate(" ", F.reverse(cut))
    at = F.when(back > 0, F.greatest(F.lit(most) - back, F.lit(most - 20))).otherwise(most - 20)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(cut, F.lit(1), at), r"[\s,;:]+$", ""), F.lit("…")))


def title_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.txt$", "")


def domain(topic: Column) -> Column:
    """What stands before the first dot; without a dot, all but the last character."""
    return F.when(topic.contains("."), F.substring_index(topic, ".", 1)).otherwise(F.substring(topic, F.lit(1), F.greatest(F.length(topic) - 1, F.lit(0))))


def lang_of(set_name: Column) -> Column:
    """What stands after the first hyphen; the whole name without one."""
    return F.regexp_replace(set_name, r"^[^-]*-", "")


def run_key(backend: Column, model: Column, raw: Column) -> Column:
    return F.concat(backend, F.lit("/"), F.replace(model, F.lit("/"), F.lit("_")), F.when(raw, "+raw").otherwise(""))


def parse_run(spec: Column, backends: list[str] | None = None) -> Column:
    """backend:model[+raw] as a struct; null for a backend that isn't known."""
    bare = F.regexp_replace(spec, r"\+raw$", "")
    backend = F.substring_index(bare, ":", 1)
    good = bare.contains(":") if backends is None else backend.isin(backends)
    return F.when(good, F.struct(backend.alias("backend"), F.regexp_replace(bare, "^[^:]*:", "").alias("model"), spec.endswith("+raw").alias("raw")))


def section_path(section: Column) -> Column:
    """``A > B > C`` without its head, joined by a thin arrow."""
    return F.array_join(F.slice(F.split(section, " > "), F.lit(2), F.greatest(F.size(F.split(section, " > ")) - 1, F.lit(0))), " › ")


def doc_id(passage_id: Column) -> Column:
    return F.substring_index(passage_id, "#", 1)


def page_link(passage_id: Column) -> Column:
    page = F.regexp_extract(passage_id, r"^(\d+)#", 1)
    return F.when(page != "", F.concat(F.lit("https://en.wikipedia.org/?curid="), page))


def dev_query_id(lang: Column, query_id: Column) -> Column:
    return F.concat(lang, F.lit("-"), F.regexp_replace(query_id, "^dev_query", ""))


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def shortened(text: Column, share: float = 0.75) -> Column:
    """The first share of the code points, as an overlong input is cut before it is sent again."""
    return F.substring(text, F.lit(1), F.floor(F.length(text) * F.lit(share)).cast("int"))


def duration_ms(text: Column) -> Column:
    """"1m2s" as milliseconds; a bare number counts seconds; nothing readable is one second."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?(?:ms|s|m|h))"), F.lit(1))
    unit = lambda p: F.regexp_extract(p, r"([a-z]+)$", 1)
    size = lambda p: F.when(unit(p) == "ms", 1.0).when(unit(p) == "s", 1000.0).when(unit(p) == "m", 60000.0).otherwise(3600000.0)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.regexp_extract(p, r"^([\d.]+)", 1).cast("double") * size(p))
    return F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double") * 1000).when(total == 0, F.lit(1000.0)).otherwise(total)


def matched_words(question: Column, passage: Column) -> Column:
    """Words of the question, as written and once each, whose lower-case form is a token of the passage."""
    found = tokens(passage)
    return F.array_distinct(F.filter(F.regexp_extract_all(question, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.array_contains(found, F.lower(w))))


def plain_question(query: Column) -> Column:
    """At most nine words, no digit, starting with a question word or auxiliary."""
    starts = r"(?i)^(what|who|when|where|which|how|why|is|are|do|does|did|was|were)\b"
    return (F.size(F.split(F.trim(query), r"\s+")) <= 9) & ~query.rlike(r"\d") & query.rlike(starts)


def gated(text: Column, needed: str, barred: str) -> Column:
    """The text where it holds a character of one class and none of another, else an empty string."""
    return F.when(text.rlike(needed) & ~text.rlike(barred), text).otherwise("")


def as_percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def as_ms(x: Column) -> Column:
    return F.when(x >= 1000, F.format_string("%.1f s", x / 1000)).otherwise(F.format_string("%.0f ms", x))


def signed_interval(diff: Column, low: Column, high: Column) -> Column:
    """+1.2 [0.3, 2.1], in percentage points."""
    return F.format_string("%+.1f [%.1f, %.1f]", diff * 100, low * 100, high * 100)


def first_match(text: Column, rules: list[tuple[str, object]], otherwise: object = None) -> Column:
    """The value of the first pattern, in the given order, that is found in the text."""
    out = F.lit(otherwise)
    for pattern, value in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(value)).otherwise(out)
    return out


def fitting_width(dims: Column, shorter: Column, most: int = 1024) -> Column:
    """Width to ask a model for so that its vectors fit a column: null for its own width, else the first of the widths it
    can shorten to that fits, or the column's width where it names none."""
    return F.when(dims <= most, F.lit(None).cast("int")).when(shorter.isNull(), F.lit(most)).otherwise(F.get(F.filter(shorter, lambda d: d <= most), F.lit(0)).cast("int"))
