"""Triples: fan-out caps, support, confidence, verdicts, repair, rules and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.once import once
from ..functions.text import extract_contract, extract_date, extract_jurisdiction, infer_type, is_entity_artifact, is_informative, is_plausible_party, mention_quality, normalize_mention, window_around
from ..session import materialise, parts_for

#: Columns of a raw triple; seq orders rows as they came in.
RAW = ["subject", "subject_type", "relation", "object", "object_type", "predicate", "sentence", "filename", "seq"]
MIN_CONFIDENCE = 0.22


def type_ok(relation: Column, subject_type: Column, object_type: Column, allowed=None) -> Column:
    """Whether the types suit the relation; a relation without a rule takes any."""
    allowed = fixed.DOMAIN_RANGE if allowed is None else allowed
    out = None
    for name, pairs in allowed.items():
        fits = reduce(lambda a, b: a | b, [(subject_type == s) & (object_type == o) for s, o in pairs])
        out = F.when(relation == name, fits) if out is None else out.when(relation == name, fits)
    return F.coalesce(out.otherwise(True), F.lit(False))


def cap_fanout(raw: DataFrame, caps=None) -> DataFrame:
    """Of single-valued relations only the best supported objects of a subject in a file; ties go to the first seen.

    Rows of such relations are dealt once, by subject, relation and file, in as many
    parts as the tables below ask for; one without subject, object or file is left out.
    """
    caps = fixed.FANOUT_CAPS if caps is None else caps
    key = ["subject", "relation", "filename"]
    capped = F.col("relation").isin(list(caps))
    same, of = Window.partitionBy(*key, "object"), Window.partitionBy(*key)
    r = raw.filter(capped).dropna(subset=[*key, "object"]).repartition(parts_for(raw), *key)
    r = r.withColumn("_n", F.count("*").over(same)).withColumn("_first", F.min("seq").over(same))
    r = r.withColumn("_rank", F.dense_rank().over(of.orderBy(F.desc("_n"), "_first", "object")))
    most = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("relation")]
    free = raw.filter(~F.coalesce(capped, F.lit(False)))
    return free.unionByName(r.filter(F.col("_rank") <= most).select(*raw.columns))


def induce_rules(raw: DataFrame, min_count: int = 5, min_support: float = 0.08, min_confidence: float = 0.6, top: int = 3) -> DataFrame:
    """(subject, relation, object, frequency, support, confidence): type pairs that a relation mostly has."""
    r = raw.filter((F.col("relation") != "OTHER") & is_informative(F.col("subject")) & is_informative(F.col("object")))
    c = r.groupBy("relation", "subject_type", "object_type").agg(F.count("*").alias("frequency"))
    of = Window.partitionBy("relation")
    c = c.select(
        "*",
        (F.col("frequency") / F.sum("frequency").over(of)).alias("support"),
        (F.col("frequency") / F.sum("frequency").over(Window.partitionBy("relation", "subject_type"))).alias("confidence"),
        F.row_number().over(of.orderBy(F.desc("frequency"), "subject_type", "object_type")).alias("rank"),
    )
    c = c.filter((F.col("rank") <= top) & (F.col("frequency") >= min_count) & (F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    return c.select(F.col("subject_type").alias("subject"), "relation", F.col("object_type").alias("object"), "frequency", "support", "confidence")


def harmonic_mean(a: Column, b: Column) -> Column:
    """Over the positive ones; 0 without any."""
    n = F.when(a > 0, 1).otherwise(0) + F.when(b > 0, 1).otherwise(0)
    total = F.when(a > 0, 1 / F.when(a > 0, a)).otherwise(0.0) + F.when(b > 0, 1 / F.when(b > 0, b)).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(n / F.when(n > 0, total))


def score(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """A row per (subject, relation, object), with the types of its first row, counts and confidence.

    Rows are dealt by subject once, in as many parts as their size asks for; counts,
    first rows and what is known of a subject are made where they then lie, so a
    subject's rows are one task's work.
    Tables of pairs of types are few rows and broadcast. Rows without subject or
    relation have no triple; a null object makes a key of its own; of rows of equal
    key and seq any may be the first; a null seq comes last; no rows give none.
    """
    key, n = ["subject", "relation", "_o", "_none"], parts_for(raw)
    r = raw.select(*RAW).filter("subject is not null").withColumn("_o", F.coalesce("object", F.lit(""))).withColumn("_none", F.col("object").isNull())
    rest = [x for x in RAW if x not in ("subject", "relation", "object")]
    row, order = F.struct("object", *rest), F.struct(F.col("seq").isNull(), F.col("seq"))
    said = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), x.alias("x"), (F.struct(order.alias("at"), row.alias("row")) if i == 0 else F.lit(None)).alias("one")) for i, x in enumerate((F.substring("sentence", 1, 160), F.lower("predicate")))]))
    first = F.min_by("one", "one.at").alias("one")
    c = r.repartition(n, "subject").select(*key, said.alias("e")).select(*key, "e.*")
    c = c.groupBy(*key, "kind", "x").agg(F.count("*").alias("rows"), first)
    is_said, known = F.col("kind") == 0, F.col("x").isNotNull()
    u = c.groupBy(*key).agg(F.sum(F.when(is_said, F.col("rows")).otherwise(0)).alias("mentions"), F.count_if(is_said & known).alias("sentence_support"), F.count_if(~is_said & known).alias("predicates"), first)
    u = u.select("subject", "relation", "one.row.object", "mentions", "sentence_support", "predicates", *[f"one.row.{x}" for x in rest])
    quality = lambda d, side: d.withColumn("_n", once(normalize_mention(F.col(side)))).withColumn(f"_q_{side}", once(mention_quality(F.col("_n"), bare=True))).drop("_n")
    of = Window.partitionBy("subject")
    u = u.withColumn("subject_mentions", F.sum("mentions").over(of)).withColumn("_k", F.row_number().over(of.orderBy("relation")))
    u = u.withColumn("_n", once(F.when(F.col("_k") == 1, normalize_mention(F.col("subject")))))  # once a name
    u = u.withColumn("_q", once(F.when(F.col("_n").isNotNull(), mention_quality(F.col("_n"), bare=True)))).withColumn("_q_subject", F.max("_q").over(of))
    u = u.drop("_k", "_n", "_q").filter("relation is not null")
    by_types = raw.groupBy("relation", "subject_type", "object_type").agg(F.count("*").alias("pair_rows"))
    by_types = by_types.withColumn("relation_rows", F.sum("pair_rows").over(Window.partitionBy("relation")))
    prior = rules.groupBy(F.col("relation"), F.col("subject").alias("subject_type"), F.col("object").alias("object_type")).agg(F.max("confidence").alias("exact_prior"))
    has_rules = rules.select("relation").distinct().withColumn("has_rules", F.lit(True))
    u = u.join(F.broadcast(by_types), ["relation", "subject_type", "object_type"]).join(F.broadcast(prior), ["relation", "subject_type", "object_type"], "left").join(F.broadcast(has_rules), "relation", "left")
    u = quality(u, "object")
    type_prior = F.coalesce("exact_prior", F.when(F.col("has_rules"), 0.0).otherwise(0.45))
    confidence = (
        0.28 * (1 - F.exp(-F.col("mentions") / 3))
        + 0.22 * (1 - F.exp(-F.col("sentence_support") / 2))
        + 0.18 * (F.col("mentions") / F.col("subject_mentions"))
        + 0.14 * F.least(F.lit(1.0), 0.55 + 0.15 * F.col("predicates"))
        + 0.10 * harmonic_mean(F.col("_q_subject"), F.col("_q_object"))
        + 0.08 * F.greatest(type_prior, F.col("pair_rows") / F.col("relation_rows"))
    )
    u = u.withColumn("type_prior", type_prior).withColumn("confidence", once(F.least(F.lit(1.0), confidence)))
    return u.drop("subject_mentions", "pair_rows", "relation_rows", "exact_prior", "has_rules", "_q_subject", "_q_object")


def verdicts(scored: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``scored`` with reject_reason: the first that fits, null for a valid triple."""
    s, o, rel = F.col("subject"), F.col("object"), F.col("relation")
    self_or_empty = (F.coalesce(s, F.lit("")) == "") | (F.coalesce(o, F.lit("")) == "") | (F.lower(s) == F.lower(o))
    prior = F.create_map(*[x for k, v in fixed.OBJECT_PRIORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[rel]
    reason = (
        F.when(self_or_empty, "empty/self triple")
        .when(~type_ok(rel, F.col("subject_type"), F.col("object_type")), "domain/range violation")
        .when(prior.isNotNull() & ~F.array_contains(prior, F.col("object_type")), "semantic type mismatch")
        .when(F.col("confidence") < min_confidence, "confidence below threshold")
    )
    return scored.withColumn("reject_reason", once(reason))


def repair(rejected: DataFrame) -> DataFrame:
    """New subject, object and types (new_*) with repair_reason; new_* are null where repair fails.

    Artifacts and empty or self triples fail. Then the first that fits: swap
    the direction, relabel types, or fill the one role that is missing from
    near the other's place in the sentence.
    """
    d = rejected.withColumn("_s", once(normalize_mention(F.col("subject")))).withColumn("_o", once(normalize_mention(F.col("object"))))
    s, o, rel, sentence = F.col("_s"), F.col("_o"), F.col("relation"), F.col("sentence")
    d = d.withColumns({"_st": once(infer_type(s, F.col("subject_type"), True)), "_ot": once(infer_type(o, F.col("object_type"), True)), "_pp": once(F.struct(is_plausible_party(s, True).alias("s"), is_plausible_party(o, True).alias("o")))})
    st, ot = F.col("_st"), F.col("_ot")
    dates = ("DATE", "EFFECTIVE_DATE")
    near = lambda f, window: F.when(window.isNotNull(), f(window)).otherwise("")
    first = lambda a, b: F.when(a, s).when(b, o).otherwise("")
    contract, date = first(st == "CONTRACT", ot == "CONTRACT"), first(st.isin(*dates), ot.isin(*dates))
    place, party = first(st == "JURISDICTION", ot == "JURISDICTION"), first(F.col("_pp.s"), F.col("_pp.o"))
    ruled = rel == "GOVERNED_BY"
    anchor = F.when(ruled, first(st.isin("CONTRACT", "PARTY"), ot.isin("CONTRACT", "PARTY"))).otherwise(party)
    anchor_type = F.when(~ruled, "PARTY").when(st.isin("CONTRACT", "PARTY"), st).otherwise(ot)
    d = d.select(
        "*",
        *[once(x).alias(n) for n, x in (("_c", contract), ("_d", date), ("_j", place), ("_p", party), ("_a", anchor), ("_at", anchor_type))],
    )
    d = d.withColumns({f"_w{x}": once(F.when(F.col(x) != "", window_around(sentence, F.col(x)))) for x in ("_c", "_d", "_p", "_a")})
    c, t, j, p, a = (F.col(x) for x in ("_c", "_d", "_j", "_p", "_a"))
    full_c = F.when(c != "", c).otherwise(F.when(rel == "EFFECTIVE_ON", near(extract_contract, F.col("_w_d"))).otherwise(near(extract_contract, F.col("_w_p"))))
    full_t = F.when(t != "", t).otherwise(near(extract_date, F.col("_w_c")))
    full_j = F.when(j != "", j).otherwise(near(extract_jurisdiction, F.col("_w_a")))
    d = d.select("*", once(full_c).alias("_fc"), once(full_t).alias("_ft"), once(full_j).alias("_fj"))
    fc, ft, fj = F.col("_fc"), F.col("_ft"), F.col("_fj")
    row = lambda w, x, y, z, r: F.struct(w.alias("s"), x.alias("st"), y.alias("o"), z.alias("ot"), r.alias("r"))
    none = F.lit(None).cast("string")
    fail = lambda r: row(none, none, none, none, F.lit(r))
    lit = F.lit
    placed = rel.isin("GOVERNED_BY", "LOCATED_IN", "ORGANIZED_UNDER")
    fixed_row = (
        F.when(is_entity_artifact(s, True) | is_entity_artifact(o, True), fail("artifact_entity"))
        .when((s == "") | (o == "") | (F.lower(s) == F.lower(o)), fail("empty_or_self"))
        .when(~type_ok(rel, st, ot) & type_ok(rel, ot, st), row(o, ot, s, st, lit("direction_swap")))
        .when(type_ok(rel, st, ot), row(s, st, o, ot, lit("type_relabel")))
        .when((rel == "EFFECTIVE_ON") & (fc != "") & (ft != ""), row(fc, lit("CONTRACT"), ft, lit("DATE"), lit("effective_on_contract_date_repair")))
        .when(rel.isin("PARTY_OF", "ENTERED_INTO") & (p != "") & (fc != ""), row(p, lit("PARTY"), fc, lit("CONTRACT"), F.concat(F.lower(rel), lit("_party_contract_repair"))))
        .when(placed & (a != "") & (fj != ""), row(a, F.col("_at"), fj, lit("JURISDICTION"), F.concat(F.lower(rel), lit("_jurisdiction_repair"))))
        .otherwise(fail("unrepairable_schema_violation"))
    )
    d = d.withColumn("_f", once(fixed_row))
    new = [F.col(f"_f.{k}").alias(n) for k, n in (("s", "new_subject"), ("st", "new_subject_type"), ("o", "new_object"), ("ot", "new_object_type"), ("r", "repair_reason"))]
    return d.select(*rejected.columns, *new)


def validate_with_repairs(raw: DataFrame, rules: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """A row per distinct triple with its status: validated, repaired or rejected.

    What can be repaired is scored again as a pool of its own, and each
    original is resolved once. Both passes are written to the shared folder,
    since several steps read each. Repaired rows carry the new confidence and keep
    the old values as original_*.
    """
    judged = materialise(verdicts(score(raw, rules), min_confidence), "judged")
    good = judged.filter("reject_reason is null").withColumn("validation_status", F.lit("validated"))
    tried = materialise(repair(judged.filter("reject_reason is not null")), "repaired")
    pool = tried.filter("new_subject is not null").select(
        F.col("new_subject").alias("subject"), F.col("new_subject_type").alias("subject_type"), "relation", F.col("new_object").alias("object"), F.col("new_object_type").alias("object_type"), "predicate", "sentence", "filename", "seq"
    )
    again = verdicts(score(pool, rules), min_confidence).select(F.col("subject").alias("new_subject"), "relation", F.col("object").alias("new_object"), F.col("confidence").alias("new_confidence"), F.col("reject_reason").alias("new_reason"))
    done = tried.join(again, ["new_subject", "relation", "new_object"], "left")
    ok = F.col("new_subject").isNotNull() & F.col("new_reason").isNull()
    keep = lambda new, old: F.when(ok, F.col(new)).otherwise(F.col(old)).alias(old)
    names = [c for c in good.columns if c != "validation_status"]
    swapped = {"subject": "new_subject", "subject_type": "new_subject_type", "object": "new_object", "object_type": "new_object_type", "confidence": "new_confidence"}
    fixed_rows = done.select(
        *[keep(swapped[c], c) if c in swapped else F.col(c) for c in names],
        F.when(ok, "repaired").otherwise("rejected").alias("validation_status"),
        "repair_reason",
        *[F.col(c).alias(f"original_{c}") for c in ("subject", "subject_type", "object", "object_type")],
    )
    return good.unionByName(fixed_rows, allowMissingColumns=True)


def repair_summary(resolved: DataFrame) -> DataFrame:
    """Counts, rates and the accounting of all distinct triples in one row."""
    n, s = F.count("*"), F.col("validation_status")
    v, r = F.count_if(s == "validated"), F.count_if(s == "repaired")
    return resolved.agg(
        n.alias("unique_triples"), v.alias("validated"), r.alias("repaired"), F.count_if(s == "rejected").alias("rejected"),
        F.round(F.try_divide(v, n), 6).alias("pass_rate"), F.round(F.try_divide(v + r, n), 6).alias("pass_rate_repaired"),
    )


def reasons(resolved: DataFrame) -> DataFrame:
    """(validation_status, reason, n, share): why triples were rejected or how they were repaired, and the share of each in its status.

    Of validated triples the reason is "none"; of repaired ones the way of the
    repair, of rejected ones the bucket of the reject reason.
    """
    s = F.col("validation_status")
    why = F.when(s == "validated", "none").when(s == "repaired", F.coalesce("repair_reason", F.lit("none"))).otherwise(reject_bucket(F.coalesce("reject_reason", F.lit(""))))
    n = resolved.groupBy("validation_status", why.alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("validation_status")), 6))


def proxy_metrics(judged: DataFrame) -> DataFrame:
    """Without gold data: mean confidence of what passed as precision, the share that passed as recall, their F1; zeros of an empty table."""
    good = F.col("reject_reason").isNull()
    d = judged.agg(F.coalesce(F.avg(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide(F.count_if(good), F.count("*")), F.lit(0.0)).alias("r"), F.coalesce(F.avg(F.when(~good, F.col("confidence"))), F.lit(0.0)).alias("x"))
    p, r = F.col("p"), F.col("r")
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return d.select(F.round(p, 6).alias("precision_proxy"), F.round(r, 6).alias("recall_proxy"), F.round(f1, 6).alias("f1_proxy"), F.round("x", 6).alias("mean_rejected"))


def object_leaks(judged: DataFrame) -> DataFrame:
    """(relation, subject_type, object_type, n, leak) of what passed; leak where the types do not suit the relation."""
    n = judged.filter("reject_reason is null").groupBy("relation", "subject_type", "object_type").agg(F.count("*").alias("n"))
    return n.withColumn("leak", ~type_ok(F.col("relation"), F.col("subject_type"), F.col("object_type")))


def by_frequency(rules: DataFrame, most: int | None = None) -> DataFrame:
    """All rules with their rank by frequency, or the first ``most``; rules are pairs of types, few whatever the data."""
    top = rules if most is None else rules.orderBy(F.desc("frequency"), "relation", "subject", "object").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "relation", "subject", "object")))


def reject_bucket(reason: Column) -> Column:
    """The bucket of a reject reason by how it starts."""
    starts = (("empty", "empty_or_self"), ("domain/range", "domain_range"), ("semantic", "semantic_type"), ("confidence", "low_confidence"))
    out = None
    for start, name in starts:
        out = F.when(reason.startswith(start), name) if out is None else out.when(reason.startswith(start), name)
    return out.otherwise("other")


def rule_relations(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples of each document by sentence patterns.

    ``mentions`` (doc_id, mention_id, label, text, start, sentence) and
    ``entities`` (mention_id, entity_id, canonical). The main contract is a
    document's first; two dates at most take effect; a place needs a phrase of
    law or seat in its sentence. Per document and key the first one stays.
    """
    m = mentions.join(entities, "mention_id")
    order = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("start", "mention_id"))
    m = m.withColumn("rank", order)
    side = lambda d, p: d.select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in ("entity_id", "canonical", "label", "sentence", "rank", "start")])
    of = lambda label: m.filter(F.col("label") == label)
    contract = side(of("CONTRACT").filter("rank = 1"), "c")
    party, date, place = side(of("PARTY"), "p"), side(of("EFFECTIVE_DATE").filter("rank <= 2"), "d"), side(of("JURISDICTION"), "j")
    has = lambda c, pattern: F.col(c).rlike(rf"(?i)\b(?:{pattern})\b")
    triple = lambda d, a, name, b, conf, said, at: d.select("doc_id", F.col(f"{a}_entity_id").alias("sid"), F.col(f"{a}_canonical").alias("subject"), F.lit(name).alias("predicate"), F.col(f"{b}_entity_id").alias("oid"), F.col(f"{b}_canonical").alias("object"), F.col(f"{a}_label").alias("subject_type"), F.col(f"{b}_label").alias("object_type"), F.lit(conf).alias("confidence"), F.substring(said, 1, 300).alias("evidence"), F.col(at).alias("at"))
    parties = triple(party.filter(has("p_sentence", "by and between|between|party|parties")).join(contract, "doc_id"), "p", "PARTY_OF", "c", 0.88, "p_sentence", "p_start")
    dates = triple(date.filter(has("d_sentence", "effective|made as of|dated as of|this agreement")).join(contract, "doc_id"), "c", "EFFECTIVE_ON", "d", 0.9, "d_sentence", "d_start")
    anchors = contract.select("doc_id", *[F.col(f"c_{c}").alias(f"a_{c}") for c in ("entity_id", "canonical", "label")])
    fallback = party.filter("p_rank = 1").select("doc_id", *[F.col(f"p_{c}").alias(f"a_{c}") for c in ("entity_id", "canonical", "label")])
    anchors = anchors.union(fallback.join(anchors, "doc_id", "left_anti"))
    laws = triple(place.filter(has("j_sentence", "governed by|laws of|state of")).join(anchors, "doc_id"), "a", "GOVERNED_BY", "j", 0.86, "j_sentence", "j_start")
    near = place.filter(has("j_sentence", "principal place of business|located at|located in")).join(party, "doc_id").filter("p_sentence = j_sentence")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "j_start", "j_entity_id").orderBy("p_start"))).filter("k <= 2")
    seats = triple(near, "p", "LOCATED_IN", "j", 0.78, "j_sentence", "p_start")
    every = parties.union(dates).union(laws).union(seats).filter("sid <> oid")
    first = F.row_number().over(Window.partitionBy("doc_id", "sid", "predicate", "oid").orderBy("at"))
    return every.withColumn("k", first).filter("k = 1").drop("k", "at", "sid", "oid")


def two_tier(triples: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """``triples`` with reason: domain_range, low_confidence or null for what is accepted."""
    rules = {k: v for k, v in fixed.DOMAIN_RANGE.items() if k in ("PARTY_OF", "EFFECTIVE_ON", "GOVERNED_BY", "LOCATED_IN")}
    ok = type_ok(F.col("predicate"), F.col("subject_type"), F.col("object_type"), rules)
    return triples.withColumn("reason", F.when(~ok, "domain_range").when(F.col("confidence") < min_confidence, "low_confidence"))


def entity_pairs(sentences: DataFrame, spans: DataFrame, max_gap: int = 25) -> DataFrame:
    """Pairs of spans in one sentence with the verb phrase between them as predicate.

    ``sentences`` (doc_id, sid, start, text) and ``spans`` (doc_id, text,
    label, start, end) count characters in the document. A predicate of over
    six words, capitals or mostly marks is left out, as is a pair without one (``phrases.verb_phrase``)
    or with a gap of over ``max_gap`` words. Null texts and empty tables give no pairs.
    """
    from ..functions.once import once
    from ..functions.text import is_junk_predicate, normalize_predicate, words
    from .phrases import verb_phrase

    s = sentences.select("doc_id", "sid", F.col("start").alias("s0"), F.col("text").alias("sentence"))
    inside = spans.join(s, "doc_id").filter((F.col("start") >= F.col("s0")) & (F.col("start") < F.col("s0") + F.length("sentence")))
    a = inside.select("doc_id", "sid", "s0", "sentence", F.col("text").alias("entity1"), F.col("label").alias("label1"), F.col("end").alias("e1"))
    b = inside.select("doc_id", "sid", F.col("text").alias("entity2"), F.col("label").alias("label2"), F.col("start").alias("b2"))
    p = a.join(b, ["doc_id", "sid"]).filter("e1 <= b2")
    between = F.btrim(F.expr("substring(sentence, e1 - s0 + 1, b2 - e1)"))
    p = p.withColumn("gap", F.size(words(between))).filter(F.col("gap") <= max_gap).withColumn("predicate", once(verb_phrase(between)))
    n = F.size(words(F.col("predicate")))
    good = n.between(1, 6) & ~F.lower("predicate").isin(fixed.GARBAGE_PREDICATES) & ~is_junk_predicate(F.col("predicate")) & (F.upper("predicate") != F.col("predicate"))
    return p.filter(good).select("doc_id", "sid", "entity1", "label1", "entity2", "label2", "predicate", normalize_predicate(F.col("predicate")).alias("relation"), "sentence")


def prf(predicted: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """True and false positives, misses, precision, recall and F1 of distinct keys."""
    p, g = predicted.select(*key).distinct(), gold.select(*key).distinct()
    j = p.withColumn("_p", F.lit(1)).join(g.withColumn("_g", F.lit(1)), key, "full_outer")
    tp, n, m = F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()), F.count("_p"), F.count("_g")
    d = j.agg(tp.alias("tp"), (n - tp).alias("fp"), (m - tp).alias("fn"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return d.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))
