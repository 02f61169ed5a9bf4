"""What each sentence does, and the action items and decisions that follow from it.

``analyse`` is a staged projection: word classes, flags, what each rule takes, the first
accepted rule, then one result per rule family.  Stages are separate selects so that
the words of a sentence are looked up once and each rule runs once, on two signs a word.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import grammar as G
from ..functions import phrases as P
from ..functions import sentence_rules as R
from ..functions import text as T
from ..functions import values as V
from ..session import cut
from .blocks import block_scan, index_block, with_halo

RULES = R.SENTENCE_RULES
ACTION_INTENTS = ["request", "assignment", "commitment", "collective"]
ACTIONABLE = ["request", "collective", "proposal", "assignment", "open_item", "commitment"]
ANALYSIS = ("struct<intent:string,confidence:double,description:string,owner:string,due:string,rationale:string,"
            "is_question:boolean,is_conditional:boolean,is_hedged:boolean>")


#: Heading of every verb that the rule of open questions can take.
OPEN_HEADS = {**R.OPEN_HEADINGS, **{form: R.OPEN_HEADINGS[verb] for form, verb in R.PARTICIPLES.items()}}


def _result(intent: str, confidence: str, description: str, owner="NULL", due="NULL", rationale="NULL", question="false", conditional="false", hedged="false") -> str:
    return (f"named_struct('intent', {intent}, 'confidence', round(least(greatest({confidence}, 0.0D), 1.0D), 4), 'description', {description}, 'owner', {owner}, 'due', {due}, "
            f"'rationale', {rationale}, 'is_question', {question}, 'is_conditional', {conditional}, 'is_hedged', {hedged})")


def _less(**amounts: str) -> str:
    """A sum that takes off each amount, in hundredths by its name, where its condition holds."""
    return " ".join(f"- CASE WHEN {condition} THEN {int(name.split('_')[1]) / 100}D ELSE 0.0D END" for name, condition in amounts.items())


def by_form(df: DataFrame, text: Column, work: Callable[[DataFrame], DataFrame], known: str | None = None) -> DataFrame:
    """``df`` with ``__seen``, found by ``work`` (from ``__form`` and ``__known``) once for each different text.

    Short sentences come back often, and no rule tells two numbers of as many digits (three at least)
    apart, so texts that differ only in their one number have one form, in which its digits are
    zeros (``__zeros``, for those of ``__number``).  Forms are found by a distinct and joined by
    equality; where all texts differ every one is a form.
    """
    rows = df.withColumn("__number", T.only_number(text)).withColumn("__zeros", F.translate("__number", "123456789", "000000000"))
    rows = rows.withColumn("__form", F.when(F.col("__number").isNull(), text).otherwise(F.replace(text, F.col("__number"), F.col("__zeros"))))
    key = ["__form"]
    if known:
        rows, key = rows.withColumn("__known", F.coalesce(F.array_sort(known), F.array().cast("array<string>"))), [*key, "__known"]
    forms = cut(rows.select(*key).where("__form is not null").distinct(), wide=True)
    return rows.join(cut(work(forms).select(*key, "__seen")), key, "left")


def analyse(df: DataFrame, raw: str, out: str = "analysis", known: str | None = None, nested: bool = True) -> DataFrame:
    """Add ``out``: intent, confidence, description, owner, due, rationale and flags of the text in ``raw``.

    ``known`` names an array column of names accepted although they look like
    ordinary capitalised words.  Null text gives a null-intent result.
    """
    def work(forms: DataFrame) -> DataFrame:
        for cols in _stages("__form", "__seen", "__known" if known else None, nested, id(SparkSession.getActiveSession()._jvm)):
            forms = forms.select("*", *cols)
        return forms

    def told(field: str) -> Column:
        return F.when(F.col("__number").isNull(), F.col(f"__seen.{field}")).otherwise(F.replace(f"__seen.{field}", "__zeros", "__number")).alias(field)

    texts = ("description", "owner", "due", "rationale")
    fields = [told(f) if f in texts else F.col(f"__seen.{f}") for f in ("intent", "confidence", *texts, "is_question", "is_conditional", "is_hedged")]
    return by_form(df, F.col(raw), work, known).select(*df.columns, F.when(F.col("__seen").isNotNull(), F.struct(*fields)).cast(ANALYSIS).alias(out))


def urgency(df: DataFrame, text: Column, out: str = "urgency") -> DataFrame:
    """Add the urgency level of ``text`` by the default signals (:func:`labels.score_urgency`)."""
    from ..functions.labels import score_urgency
    seen = by_form(df, F.coalesce(text, F.lit("")), lambda forms: forms.withColumn("__seen", score_urgency(F.col("__form"))))
    return seen.select(*[c for c in df.columns if c != out], F.col("__seen").alias(out))


@lru_cache(maxsize=32)
def _stages(raw: str, out: str, known: str | None, nested: bool, jvm: int) -> list[list[Column]]:
    """Projections of ``analyse`` in order.  They refer to columns by name only, so one set serves every DataFrame."""
    p = f"__{out}_"
    stages: list[list[Column]] = []

    def c(name: str) -> Column:
        return F.col(p + name)

    def stage(**cols: Column) -> None:
        stages.append([e.alias(p + n) for n, e in cols.items()])

    def said(**texts: str) -> None:
        """A stage of SQL texts, in which ``$name`` is a column of an earlier stage."""
        stages.append([F.expr(re.sub(r"\$([a-z]\w*)", lambda m: f"`{p}{m[1]}`", t)).alias(p + n) for n, t in texts.items()])

    stage(text=T.clean_text(F.col(raw)))
    text = c("text")
    stage(words=F.size(T.tokens_basic(text)), q=T.matches(text, P.QUESTION))
    said(pieces=G.pieces("$text"))
    said(signs=G.signs("$pieces"))
    signs = "$signs"
    said(cond=f"{G.starts(signs, R.CONDITION_START)} OR {G.holds(signs, R.CONDITION)}", hedge=G.holds(signs, R.HEDGE), done=G.holds(signs, R.DONE), prop=G.starts(signs, R.PROPOSAL),
         agree=f"{G.starts(signs, R.AGREEMENT)} AND $words <= 8", disagree=f"{G.starts(signs, R.DISAGREEMENT)} AND $words <= 10")
    rules = ", ".join(G.taken(signs, r.takes, r.then) for r in RULES)
    # what each rule takes, by its number
    said(all=f"CASE WHEN $words >= 2 AND NOT $agree AND NOT $disagree THEN array({rules}) END")

    promise = next(r for r in RULES if r.intent == "commitment")
    took = {r.number: f"$all[{r.number - 1}]" for r in RULES}
    said(promised=f"CASE WHEN {G.behind(signs, took[promise.number])} RLIKE '^p[,;\\\\-–]' THEN {G.after('$pieces', took[promise.number])} END")
    stage(tail=T.strip(F.regexp_replace(c("promised"), "^[ ,;\\-–]+", "")))
    if nested:
        stage(again=F.when(T.matches(c("tail"), r"^(?:i|we|let me)\b"), c("tail")))
        stages.extend(_stages(p + "again", p + "inner", known, False, jvm))
        said(inner_ok="coalesce($inner.intent IN ('commitment', 'collective') AND $inner.description <> '', false)")
    else:
        said(inner_ok="false")

    def guard(r: R.SentenceRule) -> str:
        """When a rule that fits is accepted."""
        mine, rest = took[r.number], G.behind(signs, took[r.number])
        hit, calm = f"{mine} IS NOT NULL", f"NOT {G.holds(mine, R.NEGATION)}"
        if r.intent == "open_item":
            return hit
        if r.takes.group("verdict"):
            subject = G.part_of(G.noted("$pieces", mine), r.takes, "subj")
            return f"{hit} AND NOT $q AND {calm} AND lower(split({subject}, ' ')[0]) NOT IN ('it', 'that', 'this', 'what', 'which')"
        if r.intent == "decision":
            return f"{hit} AND NOT $q AND {calm} AND NOT {G.starts(rest, R.DECISION_NOUN_USE)} AND {G.starts(rest, G.whole(R.DECISION_OPENING) + R.TWO_WORDS)}"
        return f"{hit} AND ({calm}{' OR $inner_ok' if r.intent == 'commitment' else ''})"

    said(rule="CASE " + " ".join(f"WHEN {guard(r)} THEN {r.number}" for r in RULES) + " END")
    said(took="get($all, $rule - 1)", intent="get(array(" + ", ".join(f"'{r.intent}'" for r in RULES) + "), $rule - 1)", base="get(array(" + ", ".join(f"{r.base}D" for r in RULES) + "), $rule - 1)")
    said(noted=f"CASE WHEN $rule IN ({', '.join(str(r.number) for r in RULES if '(?P<' in r.takes.signs)}) THEN {G.noted('$pieces', '$took')} END",
         left=G.after("$pieces", "$took"), behind=G.behind(signs, "$took"))

    def capture(*names: str) -> str:
        arms = [f"WHEN {r.number} THEN coalesce({', '.join(G.part_of('$noted', r.takes, n) for n in names if r.takes.group(n))})" for r in RULES if any(r.takes.group(n) for n in names)]
        return f"CASE $rule {' '.join(arms)} END"

    obtains = ", ".join(str(r.number) for r in RULES if r.takes.group("obtain"))
    said(owner=capture("owner", "owner2"), voc=capture("voc"), verb=f"lower({capture('verb')})", subj=capture("subj"), verdict=capture("verdict"), prep=f"lower({capture('prep')})",
         obtain=f"coalesce($rule IN ({obtains}), false)", opened=f"CASE WHEN $intent = 'decision' THEN {G.after(G.pieces('$left'), 'coalesce(' + G.taken('$behind', R.DECISION_OPENING) + ", '')")} END")
    stage(rest=T.strip(c("left")))
    intent = c("intent")
    flags = dict(question="$q", conditional="$cond", hedged="$hedge")

    # still open
    subject = T.replace(T.replace(T.strip_terminal(c("rest")), P.OPEN_SUBJECT_LEAD), P.OPEN_SUBJECT_FILLER)
    stage(subject=F.when(intent == "open_item", subject), dbody=F.when((intent == "decision") & c("verdict").isNull(), T.strip_terminal(T.strip(c("opened")))),
          abody0=F.when(intent.isin(*ACTION_INTENTS), T.strip_terminal(F.when((intent == "commitment") & c("tail").isNotNull(), c("tail")).otherwise(c("rest")))))
    heads = "map(" + ", ".join(f"{G.quoted(v)}, {G.quoted(h)}" for v, h in OPEN_HEADS.items()) + ")"
    said(head=f"CASE WHEN $intent = 'open_item' THEN coalesce({heads}[coalesce($verb, 'decide')], 'Decide on') END",
         due=f"CASE WHEN $rule IS NOT NULL THEN {T.due_words(signs, '$pieces')} END", bsigns=G.signs(G.pieces("coalesce($dbody, $abody0)")),
         abody="CASE WHEN $obtain AND $abody0 <> '' THEN concat('Obtain ', lower(left($abody0, 1)), substr($abody0, 2)) ELSE $abody0 END")
    said(is_vague=G.starts("$bsigns", R.VAGUE), flow=G.starts("$bsigns", R.MEETING_FLOW), asks=G.starts("$bsigns", R.INFORMATION_REQUEST), talk=G.starts("$bsigns", R.IN_MEETING_TALK),
         no_task=G.starts("$bsigns", R.NOT_A_TASK), soft_prefix=G.holds("$took", R.SOFT_PREFIX), soft=G.starts(signs, R.SOFT_OPENING), third=G.starts(signs, R.THIRD_PARTY),
         wh=G.starts(signs, R.WH_QUESTION), suggested=f"CASE WHEN $prop THEN {G.after('$pieces', G.taken(signs, R.PROPOSAL))} END",
         verb_ok=f"$obtain OR {T.starts_with_action_verb('$abody', '$bsigns')}")
    negative = F.when(T.matches(c("dbody"), r"^not\s+\w+ing\b"), F.concat(F.lit("Not "), F.substring(c("dbody"), 5, 2 ** 30))).otherwise(
        T.replace(c("dbody"), r"^not\s+", "Do not "))
    after_verdict = T.strip_terminal(F.when(c("verdict").isNotNull(), c("rest")))
    stage(negative=negative, after_verdict=after_verdict)
    said(ruled="concat(upper(left($subj, 1)), substr($subj, 2), CASE WHEN lower($subj) LIKE '%s' THEN ' are ' ELSE ' is ' END, lower($verdict), "
               "CASE WHEN $after_verdict <> '' THEN concat(' ', $after_verdict) ELSE '' END)")
    stage(dparts=T.split_rationale(F.coalesce(c("negative"), c("ruled"), c("abody"))))
    said(dhead="$dparts.head", vague="$abody = '' OR (NOT $obtain AND $is_vague)")
    said(dsigns="CASE WHEN $prep IN ('on', 'upon', 'with') THEN " + G.signs(G.pieces("$dhead")) + " END")
    said(on_thing=f"$prep IN ('on', 'upon', 'with') AND NOT {T.starts_with_action_verb('$dhead', '$dsigns')} AND NOT $dhead RLIKE {G.quoted(T.FLAGS + P.TASK_LIKE_DECISION)}",
         lowered="CASE WHEN $dhead RLIKE '^\\\\p{Lu}' AND NOT split($dhead, ' ')[0] RLIKE '^[^a-z]*[A-Z][^a-z]*$' THEN concat(lower(left($dhead, 1)), substr($dhead, 2)) ELSE $dhead END",
         named=f"CASE WHEN {T.name_like('split($owner, chr(32))[0]', known)} THEN $owner END", called=f"CASE WHEN {T.name_like('$voc', known)} THEN $voc END")
    said(told="CASE WHEN $on_thing THEN concat('Go with ', $lowered) ELSE $dhead END", person="coalesce($named, $called)",
         asks_who=f"$head = 'Decide on' AND $subject RLIKE {G.quoted(T.FLAGS + P.OPEN_SUBJECT_QUESTION)}")
    suggestion = T.replace(T.strip(c("suggested")), P.PROPOSAL_SUBJECT)
    stage(open_text=T.strip_terminal(F.concat(F.when(c("asks_who"), F.lit("Decide")).otherwise(c("head")), F.lit(" "), c("subject"))),
          line=T.capitalize_first(c("told")), suggestion=T.capitalize_first(T.strip_terminal(suggestion)))

    general = lambda conf: _result("'general'", conf, "$text")
    opened = _result("'open_item'", "$base " + _less(by_35="$q", by_40="$cond"), "$open_text", due="$due", **flags)
    decided = _result("'decision'", "$base " + _less(by_60="$cond", by_35="$hedge OR $prop", by_20="$soft_prefix", by_30="$soft", by_20_more="$third"), "$line",
                      due="$due", rationale="$dparts.rationale", **flags)
    ruled = _result("'decision'", "$base", "$line", rationale="$dparts.rationale", **flags)
    unclear = "NOT $verb_ok AND NOT $vague"
    sure = "$base " + _less(by_25=f"$intent = 'collective' AND {unclear}", by_12=f"$intent <> 'collective' AND {unclear}", by_40="$q AND $intent <> 'request'", by_50="$cond",
                            by_20="$hedge", by_45="$done", by_10="$prop AND $intent = 'collective'")
    sure += " + CASE WHEN $due IS NOT NULL THEN 0.08D ELSE 0.0D END + CASE WHEN $person IS NOT NULL THEN 0.05D ELSE 0.0D END " + _less(by_10="$vague")
    acted = _result("$intent", sure, "CASE WHEN $vague THEN '' ELSE $line END", owner="$person", due="$due", **flags)
    said(**{"": f"""CASE
      WHEN $text IS NULL THEN NULL
      WHEN $text = '' THEN {_result("'general'", "0.0D", "''")}
      WHEN $agree THEN {_result("'agreement'", "0.6D", "$text")}
      WHEN $disagree THEN {_result("'disagreement'", "0.6D", "$text")}
      WHEN $words < 2 THEN {_result("'general'", "0.0D", "$text", question="$q")}
      WHEN $intent = 'commitment' AND $inner_ok THEN {"$inner" if nested else "NULL"}
      WHEN $intent = 'open_item' AND NOT $subject RLIKE '[A-Za-z0-9]' THEN {general("0.2D")}
      WHEN $intent = 'open_item' THEN {opened}
      WHEN $intent = 'decision' AND $verdict IS NOT NULL THEN {ruled}
      WHEN $intent = 'decision' AND $flow THEN {general("0.2D")}
      WHEN $intent = 'decision' THEN {decided}
      WHEN $intent = 'request' AND $asks THEN {_result("'question'", "0.5D", "$text", question="true")}
      WHEN $intent = 'commitment' AND $talk THEN {general("0.2D")}
      WHEN $intent <> 'request' AND $no_task THEN {general("0.25D")}
      WHEN $intent IS NOT NULL THEN {acted}
      WHEN $prop THEN {_result("'proposal'", "0.5D", "CASE WHEN $suggestion = '' THEN $text ELSE $suggestion END", question="$q", hedged="true")}
      WHEN $q OR $wh THEN {_result("'question'", "0.5D", "$text", question="true")}
      WHEN $done THEN {_result("'done'", "0.5D", "$text")}
      ELSE {_result("'general'", "0.0D", "$text", **flags)} END"""})
    stages[-1] = [stages[-1][0].cast(ANALYSIS).alias(out)]
    return stages


def sentences(utterances: DataFrame) -> DataFrame:
    """One row per sentence with its dense position ``sidx`` in the meeting."""
    # stored, since the scan reads it twice
    split = cut(utterances.select("meeting_id", "segment_index", "speaker", T.split_sentences(F.col("text")).alias("__s")))
    placed = block_scan(split, ["meeting_id"], index_block("segment_index"), ["segment_index"],
                        sums={"__upto": F.size("__s").cast("long")})
    return placed.select(
        "meeting_id", "segment_index", "speaker", (F.col("__upto") - F.size("__s")).alias("__base"),
        F.posexplode("__s").alias("sent_no", "raw")).withColumn("sidx", F.col("__base") + F.col("sent_no")).drop("__base")


def infer_speaker_names(utterances: DataFrame) -> DataFrame:
    """First self-introduction of every unnamed label: meeting_id, speaker, name."""
    opening = F.slice(T.split_sentences(F.col("text")), 1, 3)
    maybe = r"\b" + P.one_of(*R.INTRO_WORDS) + r"\b"
    said = (utterances.filter(T.matches(F.col("speaker"), V.SPEAKER_LABEL) & T.matches(F.col("text"), maybe))
            .select("meeting_id", "speaker", "segment_index", F.posexplode(opening).alias("sent_no", "s")).filter(T.matches(F.col("s"), maybe)))
    name = f"coalesce({G.part_inside('n', R.INTRO, 'name')}, {G.part_inside('n', R.INTRO_HERE, 'name', at_start=True)})"
    # one expression, so that no part of it is computed again where the name is tested
    said = said.withColumn("name", F.expr(f"transform(array({G.pieces('s')}), p -> transform(array({G.signs('p')}), g -> transform(array({G.noted('p', 'g')}), n -> {name})[0])[0])[0]"))
    first = F.min_by("name", F.when(T.looks_like_name(F.col("name")), F.struct("segment_index", "sent_no"))).alias("name")
    return said.groupBy("meeting_id", "speaker").agg(first).where("name is not null")


def speaker_names(utterances: DataFrame, user_names: DataFrame | None = None, pretty: bool = False) -> DataFrame:
    """Display name per label: name set by a user, else introduced, else the label (or ``Speaker N``)."""
    from ..functions.labels import display_name
    labels = utterances.select("meeting_id", "speaker").distinct()
    inferred = infer_speaker_names(utterances).withColumnRenamed("name", "inferred")
    out = labels.join(inferred, ["meeting_id", "speaker"], "left")
    if user_names is None:
        out = out.withColumn("user_name", F.lit(None).cast("string"))
    else:
        out = out.join(user_names.select("meeting_id", F.col("label").alias("speaker"), F.col("name").alias("user_name")),
                       ["meeting_id", "speaker"], "left")
    shown = (display_name(F.col("user_name"), F.col("inferred"), F.col("speaker")) if pretty else
             F.coalesce(F.nullif("user_name", F.lit("")), "inferred", "speaker"))
    return out.withColumn("display", shown)


def context_rows(utterances: DataFrame, names: DataFrame | None = None, min_conf: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Analysed sentences with speaker names, meeting facts and neighbouring sentences."""
    names = speaker_names(utterances) if names is None else names
    odd = T.in_words(F.col("display"), V.CAP_NOT_NAME)
    # Only names that are also ordinary capitalised words matter, so the set is bounded by that list.
    facts = names.groupBy("meeting_id").agg(
        F.count("*").alias("n_speakers"), F.min("speaker").alias("low"), F.min_by("display", "speaker").alias("low_name"),
        F.max_by("display", "speaker").alias("high_name"), F.collect_set(F.when(odd, F.col("display"))).alias("known"))
    rows = cut(sentences(utterances).join(names.select("meeting_id", "speaker", "display"), ["meeting_id", "speaker"])
               .join(facts, "meeting_id"), wide=True)
    rows = analyse(rows, "raw", "a", known="known")
    rows = cut(rows.withColumn("decided", F.when((F.col("a.intent") == "decision") & (F.col("a.confidence") >= min_conf), F.col("a.description"))))
    # Only an assignment inside a decision matters here, so the continuation rule is not needed, nor any work on the other rows.
    inside = analyse(rows.where("decided is not null"), "decided", "nested", known="known", nested=False)
    rows = cut(inside.unionByName(rows.where("decided is null").withColumn("nested", F.lit(None).cast(ANALYSIS))))
    concrete = (F.col("a.description") != "") & (F.col("a.intent").isin(*ACTIONABLE) | (
        (F.col("a.intent") == "decision") & (F.col("a.confidence") < min_conf)))
    halo = with_halo(rows.withColumn("task", F.when(concrete, F.struct(
        "raw", "speaker", "display", "segment_index", F.col("a").alias("a")))), "sidx", before=3, after=1)
    w = Window.partitionBy("meeting_id", "block").orderBy("sidx")
    linked = (halo.withColumn("prev2", F.last("task", ignorenulls=True).over(w.rowsBetween(-2, -1)))
              .withColumn("prev3", F.last("task", ignorenulls=True).over(w.rowsBetween(-3, -1)))
              .withColumn("following", F.lead(F.struct("speaker", "display", F.col("a.intent").alias("intent"))).over(w)))
    return linked.filter(~F.col("is_halo")).drop("block", "is_halo", "task")


ITEM = ("struct<sub:int,segment_index:int,description:string,owner:string,due:string,confidence:double,evidence:string,"
        "kind:string,rationale:string>")


def _item(sub: int, segment: Column, description: Column, owner, due, confidence: Column, evidence: Column, kind: str,
          rationale=None) -> Column:
    def text(v):
        return (F.lit(v) if v is None else v).cast("string")
    return F.struct(F.lit(sub).alias("sub"), segment.alias("segment_index"), description.alias("description"),
                    text(owner).alias("owner"), text(due).alias("due"), F.round(confidence, 4).alias("confidence"),
                    evidence.alias("evidence"), F.lit(kind).alias("kind"), text(rationale).alias("rationale")).cast(ITEM)


def _found(rows: DataFrame, kinds: list[Column]) -> DataFrame:
    return rows.select("meeting_id", "sidx", F.col("display").alias("speaker"), F.inline(
        F.filter(F.array(*kinds), lambda x: x.isNotNull()))).drop("sub")


def _agreement(rows: DataFrame) -> tuple[Column, Column, Column]:
    """Whether an agreement counts, the task agreed to, and the joined evidence."""
    prev = F.col("prev2")
    valid = (F.col("a.intent") == "agreement") & prev.isNotNull() & (
        (prev["speaker"] != F.col("speaker")) | (F.col("n_speakers") == 1))
    return valid, prev, F.concat(T.strip(prev["raw"]), F.lit(" — "), T.strip(F.col("raw")))


def extract_action_items(rows: DataFrame, min_conf: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Action items (before de-duplication) from ``context_rows``."""
    a, raw = F.col("a"), T.strip(F.col("raw"))
    seg, speaker, other = F.col("segment_index"), F.col("speaker"), F.col("following")
    agreed, prev, both = _agreement(rows)
    accepted = F.when(agreed & (prev["a"]["intent"] == "request"), _item(
        0, prev["segment_index"], T.capitalize_first(T.resolve_pronouns(prev["a"]["description"], prev["display"], F.col("display"))),
        F.coalesce(prev["a"]["owner"], F.col("display")), prev["a"]["due"], F.least(F.lit(1.0), prev["a"]["confidence"] + 0.1), both, "task"))
    inner = F.col("nested")
    from_decision = F.when((inner["intent"] == "assignment") & inner["owner"].isNotNull() & (inner["description"] != ""), _item(
        0, seg, T.capitalize_first(inner["description"]), inner["owner"], F.coalesce(inner["due"], a["due"]),
        F.round(F.least(F.lit(1.0), a["confidence"]), 2), raw, "task"))
    still_open = F.when((a["intent"] == "open_item") & (a["confidence"] >= min_conf) & (a["description"] != ""), _item(
        0, seg, a["description"], None, a["due"], a["confidence"], raw, "open_item"))

    task = F.col("prev3")
    vague = a["description"] == ""
    desc = F.when(vague, task["a"]["description"]).otherwise(a["description"])
    conf = F.when(vague, F.least(F.lit(1.0), F.greatest(a["confidence"], task["a"]["confidence"]) + 0.05)).otherwise(a["confidence"])
    due = F.when(vague, F.coalesce(a["due"], task["a"]["due"])).otherwise(a["due"])
    evidence = F.when(vague & (a["intent"] == "commitment"), F.concat(T.strip(task["raw"]), F.lit(" — "), raw)).otherwise(raw)
    called = F.coalesce(a["owner"], T.addressee(F.col("raw"), F.col("known")))
    answered = F.coalesce(other["speaker"] != speaker, F.lit(False))
    only_other = F.when(F.col("n_speakers") == 2, F.when(speaker == F.col("low"), F.col("high_name")).otherwise(F.col("low_name")))
    asked = F.coalesce(called, F.when(answered & (other["intent"] == "agreement"), other["display"]).otherwise(only_other))
    taken_over = (a["intent"] == "request") & called.isNull() & answered & F.coalesce(other["intent"] == "commitment", F.lit(False))
    owner = (F.when(a["intent"] == "commitment", F.col("display")).when(a["intent"] == "request", asked)
             .when(a["intent"] == "assignment", a["owner"]))
    is_task = a["intent"].isin(*ACTION_INTENTS) & F.coalesce(desc != "", F.lit(False)) & ~taken_over
    staged = rows.select("*", F.when(is_task, desc).alias("__desc"), owner.alias("__owner"), conf.alias("__conf"),
                         due.alias("__due"), evidence.alias("__evidence"))
    replied_to = F.when(a["intent"].isin("request", "assignment"), F.col("__owner"))
    resolved = T.resolve_pronouns(F.col("__desc"), F.col("display"), replied_to)
    tidy = T.capitalize_first(T.strip_terminal(T.replace(resolved, P.CLOSING_COURTESY)))
    staged = staged.withColumn("__tidy", tidy)
    task_item = F.when((F.size(T.tokens_basic(F.col("__tidy"))) >= 2) & (F.col("__conf") >= min_conf), _item(
        1, seg, F.col("__tidy"), F.col("__owner"), F.col("__due"), F.round(F.col("__conf"), 2), F.col("__evidence"), "task"))
    return _found(staged, [accepted, from_decision, still_open, task_item]).drop("rationale")


def extract_decisions(rows: DataFrame, min_conf: float = V.MIN_CONFIDENCE) -> DataFrame:
    """Decisions (before de-duplication): stated ones and proposals another speaker agreed to."""
    a = F.col("a")
    agreed, prev, both = _agreement(rows)
    split = T.split_rationale(prev["a"]["description"])
    accepted = F.when(agreed & prev["a"]["intent"].isin("proposal", "collective", "decision"), _item(
        0, prev["segment_index"], T.capitalize_first(split["head"]), None, None, F.lit(0.75), both, "decision", split["rationale"]))
    stated = F.when((a["intent"] == "decision") & (a["confidence"] >= min_conf), _item(
        0, F.col("segment_index"), a["description"], None, None, a["confidence"], T.strip(F.col("raw")), "decision", a["rationale"]))
    return _found(rows, [accepted, stated]).drop("owner", "due", "kind")


def classify_segment(df: DataFrame, text: str = "text", min_conf: float = V.MIN_CONFIDENCE) -> DataFrame:
    """action_item, decision or general, with the confidence of the rule behind it."""
    seen = analyse(df, text, "__seen")
    sure = F.col("__seen.confidence") >= min_conf
    label = (F.when(F.col("__seen.intent").isin(*ACTION_INTENTS, "open_item") & sure, "action_item")
             .when((F.col("__seen.intent") == "decision") & sure, "decision").otherwise("general"))
    return seen.withColumn("label", label).withColumn(
        "label_confidence", F.coalesce("__seen.confidence", F.lit(0.0))).drop("__seen")


def extract_owner(segments: DataFrame) -> DataFrame:
    """Name before an obligation verb in the segment, else in the one before or after, else the speaker."""
    from ..functions.labels import find_person
    own = segments.withColumn("__own", find_person(F.col("text")))
    block = index_block("segment_index")
    before = block_scan(own, ["meeting_id"], block, ["segment_index"], lags={"__before": F.col("__own")})
    both = block_scan(before, ["meeting_id"], block, ["segment_index"], lags={"__after": F.col("__own")}, descending=True)
    return both.withColumn("owner", F.coalesce("__own", "__before", "__after", "speaker")).drop("__own", "__before", "__after")


def match_first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Name of the first pattern found in ``text``; for rule lists supplied by the user."""
    return reduce(lambda acc, r: F.coalesce(acc, F.when(T.matches(text, r[1]), F.lit(r[0]))), rules, F.lit(None).cast("string"))
