"""Column-to-Column text functions (cleaning, splitting, tokenising, formatting)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grammar as G
from . import phrases as P
from . import sentence_rules as R
from . import values as V

FLAGS = P.JAVA_FLAGS
CASED = "(?Ud)"


def matches(col: Column, pattern: str) -> Column:
    """Case-insensitive search for ``pattern`` in ``col``."""
    return col.rlike(FLAGS + pattern)


def replace(col: Column, pattern: str, with_: str = "", flags: str = FLAGS) -> Column:
    return F.regexp_replace(col, flags + pattern, with_)


def extract(col: Column, pattern: str, group: int = 0, flags: str = FLAGS) -> Column:
    """First match of a capture group; null where nothing (or nothing but '') matched."""
    return F.nullif(F.regexp_extract(col, flags + pattern, group), F.lit(""))


def strip(col: Column) -> Column:
    return replace(col, r"^\s+|\s+$")


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def word_array(words: list[str]) -> Column:
    """A constant array, built from one literal so that plans stay small."""
    return F.split(F.lit("\n".join(words)), "\n")


def in_words(col: Column, words: list[str]) -> Column:
    """Membership in a fixed list; Spark turns it into one hash lookup."""
    return col.isin(words)


def word_count(col: Column) -> Column:
    return F.when(strip(col) == "", F.lit(0)).otherwise(F.size(F.split(strip(col), CASED + r"\s+")))


def only_number(col: Column) -> Column:
    """The digits of a text that has one number, of at least three digits, and no other digit; else null."""
    return F.nullif(F.regexp_extract(col, "^[^0-9]*([0-9]{3,})[^0-9]*$", 1), F.lit(""))


# -- cleaning and splitting --------------------------------------------------

def clean_text(col: Column) -> Column:
    t = replace(strip(col), P.INLINE_FILLER)
    t = replace(t, P.LEADING_FILLER)
    t = replace(t, r"\s+", " ")
    t = replace(t, r"\s+([,.!?;:])", "$1")
    t = replace(t, r"(,\s*){2,}", ", ")
    return strip_chars(t, P.EDGE_PUNCTUATION)


def _non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_sentences(col: Column) -> Column:
    """Sentences, then clauses such as ", so she will ..."; blank text gives an empty array."""
    text = strip(col)
    sentences = _non_blank(F.split(text, CASED + P.SENTENCE_GAP))
    clauses = F.flatten(F.transform(sentences, lambda s: _non_blank(F.split(s, FLAGS + P.CLAUSE_GAP))))
    empty = F.array().cast("array<string>")
    return (F.when(F.coalesce(text, F.lit("")) == "", empty)
            .when(F.size(clauses) == 0, F.array(text)).otherwise(clauses))


def split_sentences_strict(col: Column) -> Column:
    return _non_blank(F.split(col, CASED + P.STRICT_SENTENCE_GAP))


def keeps_in_summary(sentence: Column) -> Column:
    return (word_count(sentence) >= 4) & ~matches(sentence, P.SMALL_TALK)


def summary_sentences(col: Column) -> Column:
    kept = F.filter(_non_blank(F.split(strip(col), CASED + P.STRICT_SENTENCE_GAP)), keeps_in_summary)
    return F.when(F.size(kept) == 0, F.array(col)).otherwise(kept)


# -- tokens -------------------------------------------------------------------

def tokens_basic(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9']+"), F.lit(0))


def tokens_topic(col: Column, exclude: Column | None = None) -> Column:
    bare = F.translate(F.lower(col), "’'", "")
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"[a-z][a-z0-9'+\-]{1,}"), F.lit(0)),
                        lambda w: F.btrim(w, F.lit("-")))
    kept = F.filter(found, lambda w: (F.length(w) > 2) & ~in_words(w, V.TOPIC_STOP))
    if exclude is not None:
        kept = F.filter(kept, lambda w: ~F.coalesce(F.array_contains(exclude, w), F.lit(False)))
    return kept


ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_summary(col: Column) -> Column:
    """Words of a text without punctuation; a blank at an edge gives an empty one."""
    return F.split(F.translate(F.lower(col), ASCII_PUNCTUATION, ""), CASED + r"\s+")


def counts_in_summary(word: Column) -> Column:
    return (F.length(word) > 2) & ~in_words(word, V.SUMMARY_STOP)


def tokens_summary(col: Column) -> Column:
    return F.filter(words_summary(col), counts_in_summary)


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition, without marks, is another character, and those where it is several or none.

    Hangul syllables are left whole: their decomposition maps different words to different words.
    """
    import unicodedata
    single, many = {}, {}
    for code in [*range(0xA0, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1F200)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base != chr(code):
            (single if len(base) == 1 and max(base + chr(code)) < "\U00010000" else many)[chr(code)] = base
    return "".join(single), "".join(single.values()), many


def fold_accents(col: Column) -> Column:
    """Text in compatibility decomposition without combining marks."""
    source, target, many = _decompositions()
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    # Each different letter is looked up once a text; what replaces it is itself no letter of the table.
    letters = F.array_distinct(F.regexp_extract_all(col, F.lit(r"[^\x00-\x7f]"), F.lit(0)))
    wide = F.aggregate(F.filter(letters, lambda c: in_words(c, list(many))), col, lambda t, c: F.replace(t, c, F.element_at(table, c)))
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(wide, source, target)).otherwise(col)


def normalize_text(col: Column) -> Column:
    plain = fold_accents(F.lower(col))
    spaced = replace(plain, r"[^\w\s]", " ", CASED)
    return strip(replace(spaced, r"\s+", " ", CASED))


def tokens_norm(col: Column, remove_stopwords: bool = True) -> Column:
    toks = F.filter(F.split(normalize_text(col), " "), lambda t: t != "")
    if remove_stopwords:
        toks = F.filter(toks, lambda t: ~in_words(t, V.NORM_STOP))
    return toks


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / F.size(F.array_union(a, b)))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens.  The shifted copies are zipped so ``tokens`` is not re-evaluated per element."""
    length = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    out = F.slice(tokens, 1, length)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(tokens, k + 1, length), lambda a, b: F.concat_ws(" ", a, b))
    return out


# -- casing, trimming -----------------------------------------------------------

def upper_first(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 2 ** 30))


def capitalize_first(col: Column) -> Column:
    return upper_first(strip(col))


def title_case_terms(col: Column) -> Column:
    return F.array_join(F.transform(
        F.split(col, " "), lambda w: F.when(in_words(w, V.KEEP_UPPER), F.upper(w)).otherwise(upper_first(w))), " ")


def truncate_words(col: Column, max_chars: int = 200) -> Column:
    cut = F.substring(col, 1, max_chars)
    return F.when(F.length(col) <= max_chars, col).otherwise(
        F.concat(F.regexp_replace(cut, "(?s) [^ ]*$", ""), F.lit("…")))


def strip_terminal(col: Column) -> Column:
    bare = strip(replace(strip(col), "[.!?;:, ]+$"))
    return strip(replace(bare, P.TRAILING_DISCOURSE))


# -- phrases ---------------------------------------------------------------------

def find_due(text: str) -> Column:
    """The first deadline after a word such as *by* in the text that a SQL expression names, else the first that stands alone."""
    return F.expr(f"transform(array({G.pieces(text)}), p -> transform(array({G.signs('p')}), s -> {due_words('s', 'p')})[0])[0]")


def due_words(signs: str, pieces: str) -> str:
    return f"coalesce({G.found(signs, pieces, R.DUE_PHRASE)}, {G.found(signs, pieces, R.DUE_WORD)})"


def split_rationale(col: Column) -> Column:
    """struct(head, rationale); rationale is null when no usable reason follows."""
    head = F.regexp_extract(col, FLAGS + "^(.*?)" + P.RATIONALE_MARK + "(.*)$", 1)
    mark = F.regexp_extract(col, FLAGS + "^(.*?)" + P.RATIONALE_MARK + "(.*)$", 2)
    tail = strip_chars(F.regexp_extract(col, FLAGS + "^(.*?)" + P.RATIONALE_MARK + "(.*)$", 3), " ,;-")
    usable = (mark != "") & (F.length(head) >= 8) & (word_count(tail) >= 2)
    return F.struct(
        F.when(usable, strip_chars(head, " ,;-")).otherwise(col).alias("head"),
        F.when(usable, capitalize_first(strip_terminal(tail))).alias("rationale"))


def looks_like_name(token: Column, known: Column | None = None) -> Column:
    by_shape = token.rlike("^[A-Z][a-z]{1,20}$") & ~in_words(token, V.CAP_NOT_NAME)
    if known is None:
        return F.coalesce(by_shape, F.lit(False))
    return F.coalesce(by_shape | F.coalesce(F.array_contains(known, token), F.lit(False)), F.lit(False))


def addressee(col: Column, known: Column | None = None) -> Column:
    first = extract(col, P.VOCATIVE_START, 1)
    last = extract(col, P.VOCATIVE_END, 1)
    return F.coalesce(F.when(looks_like_name(first, known), first), F.when(looks_like_name(last, known), last))


def sql_words(words: list[str]) -> str:
    return ", ".join(G.quoted(w) for w in words)


def starts_with_action_verb(text: str, signs: str) -> str:
    """SQL: whether the first word (the second after be, have or get) is a verb of work; both arguments name columns, ``signs`` those of the text."""
    words = f"regexp_extract_all(lower({text}), '[a-z0-9\\']+', 0)"
    first = "CASE WHEN get(t, 0) IN ('be', 'being', 'have', 'having', 'get', 'getting') AND size(t) > 1 THEN get(t, 1) ELSE get(t, 0) END"
    forms = f"transform(array({first}), w -> array(w, regexp_replace(w, '(?:ing|es|s|ed)$', ''), concat(w, 'e')))[0]"
    known = f"size(t) > 0 AND exists({forms}, f -> f IN ({sql_words(V.ACTION_VERBS)}))"
    return f"coalesce(NOT {G.starts(signs, R.IN_MEETING_TALK)} AND transform(array({words}), t -> {known})[0], false)"


def name_like(token: str, known: str | None = None) -> str:
    """SQL: :func:`looks_like_name` of a SQL text."""
    shape = f"({token} RLIKE '^[A-Z][a-z]{{1,20}}$' AND {token} NOT IN ({sql_words(V.CAP_NOT_NAME)}))"
    return f"coalesce({shape}{f' OR coalesce(array_contains(`{known}`, {token}), false)' if known else ''}, false)"


def resolve_pronouns(desc: Column, speaker: Column, other: Column) -> Column:
    """me/my/myself become the speaker, your the addressee, when those are real names."""
    def literal(name: Column) -> Column:
        return F.regexp_replace(name, r"([\\$])", r"\\$1")

    def named(name: Column) -> Column:
        return F.coalesce((name != "") & ~matches(name, V.SPEAKER_LABEL), F.lit(False))

    def sub(text: Column, pattern: str, with_: Column) -> Column:
        return F.regexp_replace(text, F.lit(pattern), with_)

    own = F.concat(literal(speaker), F.lit("'s"))
    theirs = F.concat(literal(other), F.lit("'s"))
    mine = sub(sub(sub(desc, CASED + r"\bme\b", literal(speaker)), FLAGS + r"\bmy\b", own),
               CASED + r"\bmyself\b", literal(speaker))
    out = F.when(named(speaker), mine).otherwise(desc)
    return F.when(named(other), sub(out, FLAGS + r"\byour\b", theirs)).otherwise(out)


# -- markdown ----------------------------------------------------------------------

def strip_markdown(col: Column) -> Column:
    t = F.regexp_replace(col, r"\*\*([^*]+)\*\*", "$1")
    t = F.regexp_replace(t, r"\*([^*]+)\*", "$1")
    return F.regexp_replace(t, r"`([^`]+)`", "$1")


def summary_line_kind(line: Column) -> Column:
    """heading | bullet | quote | para, or null for blank lines, rules and table rows."""
    bare = strip(line)
    return (F.when((bare == "") | (bare == "---"), F.lit(None).cast("string"))
            .when(line.startswith("#"), "heading")
            .when(line.rlike(r"^\s*[•\-]\s+") | line.rlike(r"^\s*\d+\.\s+"), "bullet")
            .when(line.startswith(">"), "quote")
            .when(line.startswith("|"), F.lit(None).cast("string"))
            .otherwise("para"))


def summary_line_text(line: Column) -> Column:
    body = (F.when(line.startswith("#"), strip(F.regexp_replace(line, "^[# ]+", "")))
            .when(line.rlike(r"^\s*[•\-]\s+"), F.regexp_replace(line, r"^\s*[•\-]\s+", ""))
            .when(line.rlike(r"^\s*\d+\.\s+"), F.regexp_replace(line, r"^\s*\d+\.\s+", ""))
            .when(line.startswith(">"), strip(F.regexp_replace(line, "^[> ]+", "")))
            .otherwise(strip(line)))
    return strip_markdown(F.regexp_replace(body, r"\s+$", ""))


def summary_points(lines: DataFrame, fallback: DataFrame, limit: int = 6) -> DataFrame:
    """meeting_id, place, point: the first paragraphs and bullets over 20 characters of each summary.

    ``lines``: meeting_id, n, line.  A meeting without any gets the first rows of
    ``fallback`` (meeting_id, n, point), its decisions and then its tasks.
    """
    kind, text = summary_line_kind(F.col("line")), summary_line_text(F.col("line"))
    own = lines.select("meeting_id", "n", text.alias("point"), kind.alias("kind")).where("kind in ('para', 'bullet') and length(point) > 20")
    rest = fallback.select("meeting_id", "n", "point").join(own.select("meeting_id").distinct(), "meeting_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("meeting_id").orderBy("n", "point"))
    return own.select("meeting_id", "n", "point").unionByName(rest).select("meeting_id", place.alias("place"), "point").where(F.col("place") <= limit)


def summary_blocks(lines: DataFrame) -> DataFrame:
    """meeting_id, n, kind, text of the blocks of each summary (meeting_id, n, line), without a heading that begins it."""
    kind = summary_line_kind(F.col("line"))
    blocks = lines.select("meeting_id", "n", kind.alias("kind"), summary_line_text(F.col("line")).alias("text")).where("kind is not null")
    first = blocks.groupBy("meeting_id").agg(F.min("n").alias("first"))
    return blocks.join(first, "meeting_id").where("kind <> 'heading' or n <> first").drop("first")
