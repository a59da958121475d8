"""Mentions out of annotated texts: spans, entities, coreference, times, events, roles and links.

Annotations of a document are tables: words (doc, word, offset, length, sent, text), terms (doc, term, lemma, pos, word),
and span tables (doc, kind, owner, term, ...). Each step is a DataFrame; a document's mentions are merged by span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: languages of references, best first.
LANGUAGES = ("en", "es", "it", "nl")
_TYPES = (("person", ("per",)), ("organization", ("org",)), ("location", ("loc", "gpe", "place")), ("misc", ("misc",)))


def spans(owners: DataFrame, terms: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, owner, begin, end, sent) of (doc, owner, term): from the first word to the end of the last one."""
    placed = terms.select("doc", "term", "word").join(words.select("doc", "word", "offset", "length", "sent"), ["doc", "word"])
    return (
        owners.select("doc", "owner", "term")
        .join(placed, ["doc", "term"])
        .groupBy("doc", "owner")
        .agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("sent").alias("sent"))
    )


def mention_id(doc: Column, begin: Column, end: Column) -> Column:
    """One id per span of a document."""
    return F.concat(doc, F.lit("#char="), begin.cast("string"), F.lit(","), end.cast("string"))


def anchor(text: Column, begin: Column, end: Column) -> Column:
    return F.substr(text, begin + 1, end - begin)


def entity_class(kind: Column) -> Column:
    """person, organization, location or misc by what the annotated type contains; null where nothing fits."""
    low = F.lower(kind)
    out = F.lit(None).cast("string")
    for name, marks in reversed(_TYPES):
        test = F.lit(False)
        for m in marks:
            test = test | low.contains(m)
        out = F.when(test, name).otherwise(out)
    return out


def reference_language(uri: Column) -> Column:
    """Language by the host of an encyclopedia URI; a host without a known language counts as the last one."""
    host = F.regexp_extract(uri, r"^[a-z]+://([^/]+)", 1)
    code = F.regexp_extract(host, r"^([a-z]{2})\.", 1)
    return F.when(~host.contains("."), F.lit(None)).when(code.isin(*LANGUAGES), code).when(host.startswith("dbpedia."), "en").otherwise(LANGUAGES[-1])


def best_reference(references: DataFrame, winner: str | None = None) -> DataFrame:
    """(doc, owner, reference) of (doc, owner, resource, reference, confidence, position).

    A reference of the source ``winner`` wins; else the first language with a reference, its highest confidence, of equal
    ones the first. Null confidence is lowest.
    """
    language = reference_language(F.col("reference"))
    rank = F.coalesce(*[F.when(language == code, i) for i, code in enumerate(LANGUAGES)], F.lit(len(LANGUAGES)))
    first = F.when(F.col("resource") == winner, 0).otherwise(1) if winner else F.lit(1)
    order = F.struct(first, rank, -F.coalesce("confidence", F.lit(-1.0)), "position", "reference")
    return references.where("reference is not null").groupBy("doc", "owner").agg(F.min_by("reference", order).alias("reference"))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(doc, owner, target) of spans (doc, owner, begin, end): the span of ``outer`` that equals or lies in each of ``inner``.

    An equal span wins, then the longest, the first, the smallest owner. Spans meet by document and by buckets of offsets,
    so a long document is no single group.
    """
    width = 256
    buckets = lambda b, e: F.explode(F.sequence(F.floor(b / width), F.floor(F.greatest(e - 1, b) / width)))
    a = inner.select("doc", "owner", "begin", "end", buckets(F.col("begin"), F.col("end")).alias("bucket"))
    b = outer.select("doc", F.col("owner").alias("target"), F.col("begin").alias("b"), F.col("end").alias("e"), F.floor(F.col("begin") / width).alias("bucket"))
    inside = (F.col("b") >= F.col("begin")) & (F.col("e") <= F.col("end"))
    order = F.struct(F.when((F.col("b") == F.col("begin")) & (F.col("e") == F.col("end")), 0).otherwise(1), F.col("b") - F.col("e"), "b", "target")
    return a.join(b, ["doc", "bucket"]).where(inside).groupBy("doc", "owner").agg(F.min_by("target", order).alias("target"))


def compatible(old: Column, new: Column) -> Column:
    """Every old type is among the new ones."""
    return F.size(F.array_except(old, new)) == 0


def merge_mentions(candidates: DataFrame) -> DataFrame:
    """(doc, begin, end, types, props, refused) of (doc, begin, end, step, owner, types, props), merged by span in order of steps.

    A candidate enriches the mention of its span when that one's types are all among its own, replaces a general object
    mention (type ``object`` only), and is refused otherwise. Participations (type ``participation``) never enrich.
    ``refused`` counts refusals. Candidates of one span are ordered by step and owner.
    """
    place = lambda x: F.struct(x["step"], x["owner"])
    earlier = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)
    w = F.array_sort(F.collect_list(F.struct("step", "owner", "types", "props")), earlier)
    none = F.create_map().cast("map<string,string>")
    start = F.struct(F.array().cast("array<string>").alias("types"), none.alias("props"), F.lit(0).alias("refused"))

    def take(kept: Column, new: Column) -> Column:
        empty = F.size(kept["types"]) == 0
        general = (F.size(kept["types"]) == 1) & F.array_contains(kept["types"], "object")
        part = F.array_contains(new["types"], "participation")
        joined = F.map_concat(F.map_filter(kept["props"], lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(new["props"], none)), k)), F.coalesce(new["props"], none))
        enriched = F.struct(F.array_union(kept["types"], new["types"]).alias("types"), joined.alias("props"), kept["refused"].alias("refused"))
        fresh = F.struct(new["types"].alias("types"), F.coalesce(new["props"], none).alias("props"), kept["refused"].alias("refused"))
        refused = F.struct(kept["types"].alias("types"), kept["props"].alias("props"), (kept["refused"] + 1).alias("refused"))
        return F.when(empty, fresh).when(~part & compatible(kept["types"], new["types"]), enriched).when(~part & general, fresh).otherwise(refused)

    return candidates.groupBy("doc", "begin", "end").agg(w.alias("all")).select("doc", "begin", "end", F.aggregate("all", start, take).alias("m")).select(
        "doc", "begin", "end", mention_id(F.col("doc").cast("string"), F.col("begin"), F.col("end")).alias("mention"), "m.types", "m.props", "m.refused"
    )


def coreference(sets: DataFrame, accepted: DataFrame) -> DataFrame:
    """New mentions of coreference sets: (doc, owner, begin, end, types).

    ``sets`` holds (doc, set_id, kind, owner, begin, end), ``accepted`` mentions (doc, owner, begin, end, types). Spans of a
    set of kind ``event`` become event mentions; other sets pass on the types of an accepted mention that one of their spans
    equals or contains, to all spans that are not mentions yet.
    """
    spans_ = sets.select("doc", "owner", "begin", "end")
    hit = contained(spans_, accepted).withColumnRenamed("target", "found")
    types = accepted.select("doc", F.col("owner").alias("found"), "types")
    named = sets.join(hit, ["doc", "owner"]).join(types, ["doc", "found"]).groupBy("doc", "set_id").agg(F.min_by("types", F.struct("begin", "end", "found")).alias("types"))
    fresh = sets.join(accepted.select("doc", "begin", "end"), ["doc", "begin", "end"], "left_anti")
    events = fresh.where("kind = 'event'").withColumn("types", F.array(F.lit("event")))
    others = fresh.where("kind is null or kind <> 'event'").join(named, ["doc", "set_id"])
    cols = ["doc", "set_id", "owner", "begin", "end", "types"]
    return events.select(*cols).unionByName(others.select(*cols))


def timex(times: DataFrame) -> DataFrame:
    """Mentions of time expressions (doc, owner, begin, end, kind, value); those without a span are left out."""
    return times.where("begin is not null and end is not null").withColumn("types", F.array(F.lit("time"), F.concat(F.lit("timex3_"), F.lower("kind"))))


def event_class(pos: Column) -> Column:
    return F.when(F.upper(pos).startswith("V"), "verb").when(F.upper(pos).startswith("N"), "noun").otherwise("other")


def participations(roles: DataFrame, predicates: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc, event, target, role) of roles (doc, owner, predicate, role, begin, end) over an entity mention."""
    met = contained(roles.select("doc", "owner", "begin", "end"), entities)
    return (
        roles.join(met, ["doc", "owner"])
        .join(predicates.select("doc", F.col("owner").alias("predicate"), F.col("mention").alias("event")), ["doc", "predicate"])
        .select("doc", "event", "target", "role")
    )


def link_mentions(links: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc, kind, source, target, begin, end): links over both spans, by the mentions at the offsets of their ends."""
    m = mentions.select("doc", "begin", "end", "mention")
    a = m.select("doc", F.col("begin").alias("from_begin"), F.col("end").alias("from_end"), F.col("mention").alias("source"))
    b = m.select("doc", F.col("begin").alias("to_begin"), F.col("end").alias("to_end"), F.col("mention").alias("target"))
    out = links.join(a, ["doc", "from_begin", "from_end"]).join(b, ["doc", "to_begin", "to_end"])
    return out.select("doc", "kind", "source", "target", F.least("from_begin", "to_begin").alias("begin"), F.greatest("from_end", "to_end").alias("end"))


def to_process(all_: DataFrame, done: DataFrame) -> DataFrame:
    """Documents not processed yet."""
    return all_.select("doc").distinct().join(done.select("doc").distinct(), "doc", "left_anti")


def statistics(mentions: DataFrame) -> DataFrame:
    """(type, n): mentions by type."""
    return mentions.select(F.explode("types").alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def visible_spans(mentions: DataFrame) -> DataFrame:
    """Mentions that a left-to-right rendering can mark: each starts where the ones marked before have ended.

    Greedy, so a sequential fold over the spans of one document, which are ordered by begin, end and owner.
    """
    ordered = F.array_sort(F.collect_list(F.struct("begin", "end", "owner")))
    start = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<begin:int,end:int,owner:string>>").alias("kept"))

    def take(state: Column, m: Column) -> Column:
        free = m["begin"] >= state["until"]
        item = F.struct(m["begin"].cast("int").alias("begin"), m["end"].cast("int").alias("end"), m["owner"].cast("string").alias("owner"))
        return F.struct(F.when(free, m["end"].cast("int")).otherwise(state["until"]).alias("until"), F.when(free, F.array_append(state["kept"], item)).otherwise(state["kept"]).alias("kept"))

    folded = mentions.where("begin is not null and end > begin").groupBy("doc").agg(ordered.alias("all")).select("doc", F.aggregate("all", start, take)["kept"].alias("kept"))
    return folded.select("doc", F.explode("kept").alias("m")).select("doc", "m.owner", "m.begin", "m.end")



def factuality(values: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention, certainty, polarity, tense) of (doc, owner, resource, value) over event mentions (doc, owner, mention).

    A property is taken from the value of the resource named like it; of several the smallest counts.
    """
    wide = values.where("value is not null").groupBy("doc", "owner").pivot("resource", ["certainty", "polarity", "tense"]).agg(F.min("value"))
    return mentions.select("doc", "owner", "mention").join(wide, ["doc", "owner"]).select("mention", "certainty", "polarity", "tense")


def document_resources(headers: DataFrame) -> DataFrame:
    """(id, property, value) rows of two resources per header (doc, uri, created, language, layers): document and annotation.

    They link to each other; nulls give no row; layers without a name are left out.
    """
    annotation = F.concat(F.col("uri"), F.lit(".naf"))
    entry = lambda i, p, v: F.struct(i.alias("id"), F.lit(p).alias("property"), v.cast("string").alias("value"))
    single = F.array(
        entry(F.col("uri"), "annotatedWith", annotation),
        entry(annotation, "annotationOf", F.col("uri")),
        entry(F.col("uri"), "created", F.col("created")),
        entry(F.col("uri"), "language", F.col("language")),
        entry(annotation, "identifier", F.col("doc")),
    )
    layers = F.transform(F.coalesce("layers", F.array().cast("array<string>")), lambda x: entry(annotation, "layer", x))
    return headers.where("uri is not null").select(F.inline(F.concat(single, layers))).where("value is not null").distinct()


#: Classes of events by the type that a reference names; what has another name is speech_cognitive.
_EVENT_CLASSES = {"cognition": "speech_cognitive", "cognitive": "speech_cognitive", "communication": "speech_cognitive", "grammatical": "grammatical", "contextual": "other"}
#: Relations of temporal links.
_RELATIONS = ("BEFORE", "AFTER", "INCLUDES", "MEASURE", "IS_INCLUDED", "SIMULTANEOUS", "IAFTER", "IBEFORE", "BEGINS", "ENDS", "BEGUN_BY", "ENDED_BY")
_CANDIDATE = ["doc", "begin", "end", "step", "owner", "types", "props"]


def _props(**values: Column) -> Column:
    """A map of the values that are not null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["v"].isNotNull()))


def event_candidates(tables: dict[str, DataFrame], placed: DataFrame, times: DataFrame) -> DataFrame:
    """Event mentions of predicates: lemma, part of speech, class, references by resource, and their times.

    ``placed`` has the spans of predicates, ``times`` the mention of each time expression (doc, owner, mention).
    """
    told = tables["predicates"].join(tables["terms"].select("doc", "term", "lemma", "pos"), ["doc", "term"]).groupBy("doc", "predicate").agg(
        F.array_join(F.sort_array(F.collect_set("lemma")), ",").alias("lemma"), F.min(event_class(F.col("pos"))).alias("pos")
    )
    refs = tables["predicate_references"]
    kind = F.coalesce(*[F.when(F.col("reference") == k, v) for k, v in _EVENT_CLASSES.items()], F.lit("speech_cognitive"))
    is_type = F.lower("resource") == "eventtype"
    classes = refs.groupBy("doc", "predicate").agg(F.coalesce(F.min(F.when(is_type, kind)), F.lit("other")).alias("class"))
    outside = (
        refs.where(~is_type & F.col("reference").isNotNull())
        .groupBy("doc", "predicate", F.concat(F.lower("resource"), F.lit("Ref")).alias("k"))
        .agg(F.array_join(F.sort_array(F.collect_set("reference")), ",").alias("v"))
        .groupBy("doc", "predicate")
        .agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("refs"))  # a row per resource of one predicate
    )
    anchors = tables["anchors"].select("doc", "predicate", F.explode(F.create_map(*[x for c in ("anchorTime", "beginPoint", "endPoint") for x in (F.lit(c), F.col(c))])).alias("k", "owner"))
    dated = anchors.join(times, ["doc", "owner"]).groupBy("doc", "predicate").pivot("k", ["anchorTime", "beginPoint", "endPoint"]).agg(F.min("mention"))
    out = placed.join(told, ["doc", "predicate"], "left")
    for more in (classes, outside, dated):
        out = out.join(more, ["doc", "predicate"], "left")
    own = _props(pred=F.col("lemma"), pos=F.col("pos"), eventClass=F.col("class"), anchorTime=F.col("anchorTime"), beginPoint=F.col("beginPoint"), endPoint=F.col("endPoint"))
    props = F.map_concat(own, F.coalesce("refs", F.create_map().cast("map<string,string>")))
    return out.select("doc", "begin", "end", F.lit(5).alias("step"), F.col("predicate").alias("owner"), F.array(F.lit("event")).alias("types"), props.alias("props"))


def role_candidates(roles: DataFrame, events: DataFrame, accepted: DataFrame) -> DataFrame:
    """Mentions of roles (doc, owner, predicate, role, begin, end): a temporal role is a time, where none is known there, and
    a link of the event to it; another role that is an accepted mention takes part in the event."""
    met = roles.join(events.select("doc", "predicate", F.col("begin").alias("b"), F.col("end").alias("e")), ["doc", "predicate"])
    known = met.join(accepted.select("doc", "begin", "end").distinct().withColumn("known", F.lit(True)), ["doc", "begin", "end"], "left")
    temporal = F.coalesce(F.upper("role") == "AM-TMP", F.lit(False))
    none = F.create_map().cast("map<string,string>")
    times = known.where(temporal & F.col("known").isNull()).select("doc", "begin", "end", F.lit(6).alias("step"), "owner", F.array(F.lit("time")).alias("types"), none.alias("props"))
    ids = {"source": mention_id(F.col("doc"), F.col("b"), F.col("e")), "target": mention_id(F.col("doc"), F.col("begin"), F.col("end"))}
    first, last = F.least("begin", "b").alias("begin"), F.greatest("end", "e").alias("end")
    linked = known.where(temporal).select("doc", first, last, F.lit(7).alias("step"), "owner", F.array(F.lit("tlink"), F.lit("relation")).alias("types"), _props(**ids).alias("props"))
    parts = known.where(~temporal & F.col("known").isNotNull())
    taking = parts.select("doc", first, last, F.lit(7).alias("step"), "owner", F.array(F.lit("participation"), F.lit("relation")).alias("types"), _props(**ids, role=F.col("role")).alias("props"))
    return times.unionByName(linked).unionByName(taking)


def link_candidates(links: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mentions of causal and temporal links over both spans, and properties of mentions that are linked to the document's time.

    ``ends`` has the spans of predicates and time expressions (doc, id, begin, end); the second result is (doc, begin, end, k, v).
    """
    a = ends.select("doc", F.col("id").alias("source"), F.col("begin").alias("a_begin"), F.col("end").alias("a_end"))
    b = ends.select("doc", F.col("id").alias("target"), F.col("begin").alias("b_begin"), F.col("end").alias("b_end"))
    all_ = links.withColumn("relation", F.when(F.col("relation").isin(*_RELATIONS), F.col("relation"))).join(a, ["doc", "source"], "left").join(b, ["doc", "target"], "left")
    start, end = F.coalesce(F.lower("source") == "tmx0", F.lit(False)), F.coalesce(F.lower("target") == "tmx0", F.lit(False))
    between = all_.where(~start & ~end).where("a_begin is not null or b_begin is not null")
    spot = lambda x: F.when(F.col(f"{x}_begin").isNotNull(), mention_id(F.col("doc"), F.col(f"{x}_begin"), F.col(f"{x}_end")))
    mentions = between.select(
        "doc", F.least("a_begin", "b_begin").alias("begin"), F.greatest("a_end", "b_end").alias("end"), F.lit(8).alias("step"), "owner", F.array(F.col("kind"), F.lit("relation")).alias("types"),
        _props(source=spot("a"), target=spot("b"), relType=F.col("relation")).alias("props"),
    )
    dated = all_.where((start | end) & F.col("relation").isNotNull()).select(
        "doc", F.when(start, F.col("b_begin")).otherwise(F.col("a_begin")).alias("begin"), F.when(start, F.col("b_end")).otherwise(F.col("a_end")).alias("end"),
        F.when(start, "tlinkFromTmx0").otherwise("tlinkToTmx0").alias("k"), F.col("relation").alias("v"),
    )
    return mentions, dated.where("begin is not null")


def extract(tables: dict[str, DataFrame], winner: str | None = None) -> DataFrame:
    """Mentions (see ``merge_mentions``) of the tables that ``files.read_annotations`` gives, layer by layer.

    1 entities: type ``object`` and their class, the best reference as ``refersTo``. 2 coreference: new spans of a set with
    the types of its accepted mention, or events. 3 times: kind and value. 4 factuality: events with their ``factBank``.
    5 predicates: events (``event_candidates``). 6 and 7 roles: times, temporal links, participations. 8 causal and temporal
    links; a link to the time of the document enriches the mention at its other end. What has no span gives none; tables of
    layers that are missing count as empty.
    """
    words, terms = tables["words"], tables["terms"]
    spark = words.sparkSession
    empty = {
        "coreferences": "doc string, set_id string, kind string, owner string, term string", "factualities": "doc string, owner string, term string, resource string, value string",
        "predicates": "doc string, predicate string, term string", "predicate_references": "doc string, predicate string, resource string, reference string",
        "anchors": "doc string, predicate string, anchorTime string, beginPoint string, endPoint string", "roles": "doc string, predicate string, owner string, role string, term string",
        "links": "doc string, kind string, owner string, source string, target string, from_type string, to_type string, relation string",
    }
    tables = {k: spark.createDataFrame([], schema) for k, schema in empty.items()} | tables
    entities = tables["entities"]
    reference = best_reference(tables["references"], winner).withColumnRenamed("owner", "entity")
    named = entities.select("doc", "owner", "entity", "kind").distinct().join(reference, ["doc", "entity"], "left")
    found = spans(entities, terms, words).join(named, ["doc", "owner"])
    kind = entity_class(F.col("kind"))
    objects = found.select(
        "doc", "begin", "end", F.lit(1).alias("step"), "owner", F.array_compact(F.array(F.lit("object"), kind)).alias("types"), _props(refersTo=F.col("reference")).alias("props")
    )
    own_spans = lambda t, key: spans(tables[t].select("doc", F.col(key).alias("owner"), "term"), terms, words).drop("sent").withColumnRenamed("owner", key)
    sets = own_spans("coreferences", "owner").join(tables["coreferences"].select("doc", "owner", "set_id", "kind").distinct(), ["doc", "owner"])
    same = coreference(sets, objects.select("doc", "owner", "begin", "end", "types")).select(
        "doc", "begin", "end", F.lit(2).alias("step"), "owner", "types", _props(coreference=F.col("set_id")).alias("props")
    )
    placed = tables["times"].where("word is not null").join(words.select("doc", "word", "offset", "length"), ["doc", "word"])
    dated = timex(placed.groupBy("doc", "owner", "kind", "value").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end")))
    times = dated.select("doc", "begin", "end", F.lit(3).alias("step"), "owner", "types", _props(value=F.col("value")).alias("props"))
    bank = tables["factualities"].groupBy("doc", "owner").agg(F.min(F.when(F.lower("resource") == "factbank", F.col("value"))).alias("bank"))
    facts = own_spans("factualities", "owner").join(bank, ["doc", "owner"]).select(
        "doc", "begin", "end", F.lit(4).alias("step"), "owner", F.array(F.lit("event")).alias("types"), _props(factBank=F.col("bank")).alias("props")
    )
    acting = own_spans("predicates", "predicate")
    moments = times.select("doc", "owner", mention_id(F.col("doc"), F.col("begin"), F.col("end")).alias("mention"))
    events = event_candidates(tables, acting, moments)
    before = [objects, same, times, facts, events]
    accepted = before[0].select("doc", "begin", "end")
    for part in before[1:]:
        accepted = accepted.unionByName(part.select("doc", "begin", "end"))
    roles = own_spans("roles", "owner").join(tables["roles"].select("doc", "owner", "predicate", "role").distinct(), ["doc", "owner"])
    ends = acting.select("doc", F.col("predicate").alias("id"), "begin", "end").unionByName(times.select("doc", F.col("owner").alias("id"), "begin", "end"))
    links, to_document = link_candidates(tables["links"], ends)
    candidates = before[0].select(*_CANDIDATE)
    for part in (*before[1:], role_candidates(roles, acting, accepted), links):
        candidates = candidates.unionByName(part.select(*_CANDIDATE))
    merged = merge_mentions(candidates)
    extra = to_document.groupBy("doc", "begin", "end", "k").agg(F.min("v").alias("v")).groupBy("doc", "begin", "end").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("extra"))
    none = F.create_map().cast("map<string,string>")
    return merged.join(extra, ["doc", "begin", "end"], "left").withColumn("props", F.map_concat("props", F.coalesce("extra", none))).drop("extra")
