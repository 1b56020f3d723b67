"""Risk analysis of agreement texts: lines, matches, filters, overlaps, scores, snippets.

Matches are rows (doc_id, token, severity, source, reason, start, end, page, line); offsets count characters from 0 of
the one canonical text (:func:`canonical`) on which everything is computed.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlens.functions import text as T
from pactlens.functions.slices import over_slices

#: Pattern, severity, reason.
PATTERNS = [
    (r"(precio).{0,10}(preferencial|preferentes?)", "HIGH", "precio preferencial"),
    (r"(cantidad|orden).{0,12}m[ií]nima", "MEDIUM", "cantidad mínima"),
    (r"mayor\s+cantidad\s+de\s+reemisiones", "HIGH", "reemisiones"),
]
#: Words of which each pattern needs one; looking for them costs a small part of looking for the patterns.
_NEEDED = ["precio", "cantidad", "orden", "mayor"]
#: What a semantic match must contain, and what near it denies it.
RISK_STEMS = ["precio preferen", "precios preferen", "menor precio", "menores precios", "exclusiv", "trato preferen", "cantidad minima", "orden minima", "volumen minimo", "piso minimo", "reemision", "reexped", "presupuesto", "aprobacion presupuestaria", "certificacion presupuestaria"]
NEGATIONS = ["no ", " no-", "no implica", "no confiere", "no constituye", "no se asumen", "sin ", "no se admit", "no reserv", "no confiere trato prefer", "no conlleva", "no genera", "no oblig", "sin exclusiv", "sujeto a normativa", "sujetas? a normativa", "conforme a normativa", "segun normativa", "de acuerdo a normativa", "no se autoriz"]
PAGE = r"(?iu)(?:p[aá]gina|page)\s+(\d+)"
SERVICE_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.35}
RULE_WEIGHTS, SEMANTIC_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.6, "LOW": 0.3}, {"HIGH": 0.15, "MEDIUM": 0.08, "LOW": 0.03}
SEVERITIES = ("HIGH", "MEDIUM", "LOW")


def canonical(docs: DataFrame) -> DataFrame:
    """``docs`` with their ``text`` in compatibility normal form and without carriage returns. Only texts that are not plain ASCII reach Python."""
    plain = ~F.col("text").rlike(r"[^\x00-\x7F]")
    return docs.withColumn("text", F.coalesce(T.nfkc(F.when(~plain, F.col("text"))), F.replace("text", F.lit("\r"), F.lit(""))))


def canonical_table(docs: DataFrame) -> DataFrame:
    """:func:`canonical` as a table in the shared folder: :func:`analyze` and what finds semantic matches read the texts
    several times, and each reading of the lazy form normalises them again, with a Python worker of its own in each task."""
    from pactlens.sources.store import stash

    return stash(canonical(docs), "canonical")


def _place_finder():
    """A function from a text to one from offsets to (page, line); the lines are looked up once for each text."""
    marker = re.compile(r"(?:p[aá]gina|page)\s+(\d+)", re.I)

    def of(text: str):
        starts, pages, page, at = [], [], 1, 0
        low = text.lower().replace("\u0307", "").replace("ı", "i")  # what the marker takes for an i
        marked = "gina" in low or "page" in low
        for line in text.split("\n"):
            found = marker.search(line) if marked else None
            if found and int(found[1]) < 1 << 31:
                page = int(found[1])
            starts.append(at)
            pages.append(page)
            at += len(line) + 1

        def place(start: int) -> tuple[int, int]:
            k = bisect.bisect_right(starts, max(0, start)) - 1
            return pages[k], k + 1

        return place

    return of


def line_index(docs: DataFrame) -> DataFrame:
    """RSK01: (doc_id, line, start, end, page, text); the page is the last page marker on this or an earlier line, at first 1."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.regexp_extract("text", PAGE, 1)
    lines = lines.withColumns({"end": F.sum(F.length("text") + 1).over(w) - 1, "page": F.last(F.when(marker != "", marker.try_cast("int")), ignorenulls=True).over(w)})
    return lines.select("doc_id", (F.col("pos") + 1).alias("line"), (F.col("end") - F.length("text")).cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("page", F.lit(1)).alias("page"), "text")


def active_terms(lexicon: DataFrame) -> DataFrame:
    """SRC02: active, not blank; of equal texts the row with the highest id; severity upper-case, MEDIUM if none."""
    clean = lexicon.where("activo").withColumn("token", F.trim("texto")).where("token <> ''")
    severity = F.coalesce(F.nullif(F.upper(F.trim("severity")), F.lit("")), F.lit("MEDIUM"))
    best = clean.groupBy("token").agg(F.max(F.struct("id", severity.alias("severity"), F.coalesce(F.trim("reason"), F.lit("")).alias("reason"))).alias("r"))
    return best.select("token", "r.severity", "r.reason")


_FOUND = "array<struct<token:string,severity:string,reason:string,start:int,end:int,page:int,line:int>>"


def _keyword_finder(terms: list) -> Callable[[list], list]:
    """Occurrences of the terms in lower-case texts: one pass of an automaton over a text, whatever the number of terms."""
    terms = [(t.token, t.token.lower(), t.severity, t.reason) for t in terms]

    made = []  # once in a task

    def automaton_of():
        import ahocorasick

        automaton, by = ahocorasick.Automaton(), {}
        for k, (_, low, *_) in enumerate(terms):
            by.setdefault(low, []).append(k)
        for low, own in by.items():
            automaton.add_word(low, (len(low), own))
        automaton.make_automaton()
        return automaton

    def found(texts: list) -> list:
        if not made:
            made.append(automaton_of())
        automaton, places = made[0], _place_finder()

        def one(text: str | None) -> list[tuple]:
            out, free, place = [], {}, None  # free: where each term may begin again
            for last, (n, own) in automaton.iter(text) if text else ():
                start = last + 1 - n
                if start < free.get(own[0], 0):
                    continue
                free[own[0]] = last + 1
                place = place or places(text)
                page, line = place(start)
                out += [{"token": terms[k][0], "severity": terms[k][2], "reason": terms[k][3], "start": start, "end": last + 1, "page": page, "line": line} for k in own]
            return out

        return list(map(one, texts))

    return found


def keyword_matches(docs: DataFrame, lexicon: DataFrame, most_terms: int = 100_000) -> DataFrame:
    """RSK02: every occurrence of each active term, without regard to case and without overlap with itself.

    The terms travel with the task, so at most ``most_terms`` of them at a time; a longer lexicon takes more passes over
    the texts. Only texts that hold a term come out of a pass.
    """
    terms = active_terms(lexicon)
    n, out = terms.count(), None
    passes = max(1, -(-n // most_terms))
    for k in range(passes):
        own = sorted(terms.where(F.pmod(F.xxhash64("token"), F.lit(passes)) == k).collect()) if n else []
        if not own:
            continue
        hits = docs.select("doc_id", F.inline(over_slices(_keyword_finder(own), _FOUND)(F.lower("text"))))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = docs.select("doc_id", F.inline(F.array().cast(_FOUND)))
    return out.select("doc_id", "token", "severity", F.lit("keyword").alias("source"), "reason", "start", "end", "page", "line")


def _pattern_spans(texts: list) -> list:
    compiled, places = [(re.compile(p, re.I), s, r) for p, s, r in PATTERNS], _place_finder()

    def one(text: str | None) -> list[dict]:
        out, place = [], places(text or "")
        for pattern, severity, reason in compiled:
            for m in pattern.finditer(text or ""):
                page, line = place(m.start())
                out.append({"token": m[0], "severity": severity, "reason": reason, "start": m.start(), "end": m.end(), "page": page, "line": line})
        return out

    return list(map(one, texts))


def pattern_matches(docs: DataFrame) -> DataFrame:
    """RSK03: occurrences of the fixed patterns; only texts that one of them can match reach Python."""
    odd = F.contains("text", F.lit("ı")) | F.contains("text", F.lit("İ"))  # a pattern takes them for an i
    held = F.exists(F.array(F.lower("text")), lambda low: F.exists(F.array(*map(F.lit, _NEEDED)), lambda w: F.contains(low, w)))
    maybe = docs.where(odd | held).where(F.col("text").rlike("(?iu)" + "|".join(f"(?:{p})" for p, _, _ in PATTERNS)))
    return maybe.select("doc_id", F.inline(over_slices(_pattern_spans, _FOUND)("text"))).select("doc_id", "token", "severity", F.lit("pattern").alias("source"), "reason", "start", "end", "page", "line")


def _shown(sentence: Column) -> Column:
    return F.when(F.length(sentence) > 100, F.concat(F.substring(sentence, 1, 100), F.lit("…"))).otherwise(sentence)


def classifier_matches(scored: DataFrame) -> DataFrame:
    """RSK04: from :func:`sentence_scores` those sure enough, at the sentence's first place in the text."""
    least = F.when(F.col("severity") == "HIGH", 0.60).when(F.col("severity") == "MEDIUM", 0.55).when(F.col("severity") == "LOW", 0.70).otherwise(0.60)
    hits = scored.where(F.col("p") >= least).withColumns({"token": _shown(F.col("sentence")), "end": F.col("start") + F.length("sentence")})
    return hits.select("doc_id", "token", "severity", F.lit("semantic").alias("source"), F.lit("").alias("reason"), "start", "end", "page", "line")


_SCORED = "array<struct<sentence:string,severity:string,p:double,start:int,page:int,line:int>>"


def _founded(text: str) -> list[tuple[int, str]]:
    """The sentences of a text that RSK06 and RSK07 leave (:func:`has_risk_stem`, :func:`negated`), whatever their class. Few texts hold a stem at all."""
    low = T.folded(text)
    if not any(s in low for s in RISK_STEMS):
        return []
    out = []
    for own in T.sentences_of(text):
        token = own[1] if len(own[1]) <= 100 else own[1][:100] + "…"
        plain = T.folded(token)
        if not any(s in plain for s in RISK_STEMS):
            continue
        at = low.find(plain)
        around = T.folded(text[max(at - 80, 0) : at + len(token) + 80]) if at >= 0 else ""
        if not any(s in around for s in NEGATIONS):
            out.append(own)
    return out


def _sentence_scorer(model, founded: bool) -> Callable[[list], list]:
    from pactlens.operators.learning import scorer

    score, labels = scorer(model), list(model.stages[0].labels)

    def scored(texts: list) -> list:
        found, places = [(_founded if founded else T.sentences_of)(t or "") for t in texts], _place_finder()
        best, p = score([s for own in found for _, s in own])
        told = zip(best.tolist(), p.tolist(), strict=True)
        out = []
        for text, own in zip(texts, found, strict=True):
            place, first, rows = places(text) if own else None, {}, []
            for at, s in own:
                start = first[s] if s in first else first.setdefault(s, text.find(s, 0, at + len(s)))
                (page, line), (k, sure) = place(start), next(told)
                rows.append({"sentence": s, "severity": labels[k], "p": sure, "start": start, "page": page, "line": line})
            out.append(rows)
        return out

    return scored


def sentence_scores(docs: DataFrame, model, founded: bool = False) -> DataFrame:
    """RSK04: each sentence's likeliest class by a pipeline of :func:`pactlens.operators.learning.train_tfidf`, and the sentence's first place: (doc_id, sentence, severity, p, start, page, line).

    ``founded`` leaves out the sentences that RSK06 and RSK07 drop whatever their class: for :func:`analyze` they need no score.
    A text goes to Python once, with all that is asked of its sentences, so no text is exchanged.
    """
    return docs.select("doc_id", F.inline(over_slices(_sentence_scorer(model, founded), _SCORED)("text")))


def semantic_matches(docs: DataFrame, model) -> DataFrame:
    """RSK04 for :func:`analyze` with ``founded``: the classifier's matches that have a risk stem and no denial near it."""
    return classifier_matches(sentence_scores(docs, model, founded=True))


def archetype_matches(vectors: DataFrame, archetypes: DataFrame, most: int = 1000) -> DataFrame:
    """RSK05: each vector's most similar archetype (vec_id, embedding) and the severity of the similarity's band.

    At most ``most`` archetypes are broadcast at a time; more of them take more passes over the vectors.
    """
    from pactlens.operators.vectors import cosine

    passes, best = max(1, -(-archetypes.count() // most)), None
    for k in range(passes):
        part = archetypes.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == k) if passes > 1 else archetypes
        pairs = vectors.crossJoin(F.broadcast(part.select(F.col("vec_id").alias("archetype"), F.col("embedding").alias("_a"))))  # a stated set against all rows
        own = pairs.withColumn("sim", cosine(F.col("embedding"), F.col("_a"))).groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("archetype")).alias("_n"))).alias("b"))
        best = own if best is None else best.unionByName(own)
    best = best.groupBy("vec_id").agg(F.max("b").alias("b")) if passes > 1 else best
    sim = F.col("b.sim")
    band = F.when(sim >= 0.80, "HIGH").when(sim >= 0.70, "MEDIUM").when(sim >= 0.60, "LOW")
    return best.select("vec_id", (-F.col("b._n")).alias("archetype"), F.round(sim, 6).alias("similarity"), band.alias("severity")).where("severity IS NOT NULL")


def has_risk_stem(token: Column) -> Column:
    """FIL13, RSK06."""
    return T.fold(token).rlike("|".join(map(re.escape, RISK_STEMS)))  # folded once; a lambda would fold for each stem


def negated(text: Column, token: Column, window: int = 80) -> Column:
    """FIL14, RSK07: a denial within ``window`` characters of the token's first place; a token that is not found is not negated."""
    at = F.instr(T.fold(text), T.fold(token))  # as an array's one element, so the text is folded once
    low = lambda a: F.greatest(a - 1 - window, F.lit(0))
    around = lambda a: T.fold(F.substring(text, low(a) + 1, a - 1 + F.length(token) + window - low(a)))
    return F.exists(F.array(at), lambda a: (a > 0) & around(a).rlike("|".join(map(re.escape, NEGATIONS))))


def filter_semantic(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """RSK06 and RSK07 on semantic matches; all others pass."""
    semantic = matches.where("source = 'semantic'").join(docs.select("doc_id", "text"), "doc_id")
    kept = semantic.where(has_risk_stem(F.col("token")) & ~negated(F.col("text"), F.col("token"))).drop("text")
    return matches.where("source <> 'semantic'").unionByName(kept)


_MERGED = "array<struct<token:string,severity:string,source:string,reason:string,start:int,end:int,page:int,line:int>>"


def _merged(documents: list) -> list:
    order = lambda s: [(s[c] is not None, s[c] or ("" if c == "token" else 0)) for c in ("start", "end", "token", "page", "line")]
    least = lambda group, c: min((s[c] for s in group if s[c] is not None), default=None)
    upper, lower = lambda x: x and x.upper(), lambda x: x and x.lower()
    alike: dict = {}

    def key(s: dict) -> tuple | None:
        """What matches that can merge have in common; None without a token."""
        own = (s["source"], s["severity"], s["token"])
        if own not in alike:
            token = (own[2] or "").strip(" ")
            alike[own] = (lower(own[0]), upper(own[1]), T.folded(re.sub(r"[ \t\n\x0b\f\r]+", " ", token))) if token else None
        return alike[own]

    def joined(spans: list[dict]) -> list[dict]:
        spans.sort(key=order)
        told = {c: least(spans, c) for c in ("source", "severity", "reason")}
        if all(y["start"] >= x["end"] for x, y in zip(spans, spans[1:], strict=False)):
            return [s | told for s in spans]
        kept: list[dict] = []
        for s in spans:
            a, b = s["start"], s["end"]
            for k in kept:
                shared, hull = min(b, k["end"]) - max(a, k["start"]), max(b, k["end"]) - min(a, k["start"])
                if hull > 0 and shared > 0 and shared / hull >= 0.60:
                    if b - a > k["end"] - k["start"]:
                        k.update(start=a, end=b, token=s["token"], page=s["page"], line=s["line"])
                    break
            else:
                kept.append(s | told)
        return kept

    def one(spans: list[dict]) -> list[dict]:
        out, groups = [], {}
        for s in spans:
            start, end = s["start"], s["end"]
            if start is None or end is None or not 0 <= start < end or (k := key(s)) is None:
                out.append(s)
            else:
                groups.setdefault(k, []).append(s)
        for own in groups.values():
            out += own if len(own) == 1 else joined(own)
        return out

    return list(map(one, documents))


def dedupe_overlaps(matches: DataFrame) -> DataFrame:
    """RSK08: matches of one document, source, severity and token that overlap by 60 % of their hull become the longer; first come, first kept.

    Matches without valid offsets or token pass. A document's matches are brought together once, those that pass among
    them: apart, they would be found a second time.
    """
    for c in ("page", "line"):
        matches = matches if c in matches.columns else matches.withColumn(c, F.lit(None).cast("int"))
    names = ["token", "severity", "source", "reason", "start", "end", "page", "line"]
    whole = matches.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("spans"))
    return whole.select("doc_id", F.inline(over_slices(_merged, _MERGED)("spans")))


def _weight(severity: str, weights: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for s, w in weights.items():
        out = F.when(F.upper(F.col(severity)) == s, w).otherwise(out)
    return out


def service_matches(docs: DataFrame, lexicon: DataFrame, model) -> DataFrame:
    """All that the service finds in canonical ``docs`` and :func:`score_service` counts: terms, patterns and the classifier's sentences.
    RSK06 to RSK08 come behind the service and touch RSK10 only. The texts are read for each kind: give them as :func:`canonical_table`."""
    return keyword_matches(docs, lexicon).unionByName(pattern_matches(docs)).unionByName(classifier_matches(sentence_scores(docs, model)))


def score_service(matches: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """RSK09: (doc_id, score, risk_level); weights are counted in hundredths, so the order of rows does not matter.

    With ``docs`` each of them has a row: without any match its score is 0 and its level BAJO.
    """
    weight = (_weight("severity", SERVICE_WEIGHTS, 0.35) * 100).cast("long")
    found = matches.select("doc_id", weight.alias("w"))
    found = found if docs is None else found.unionByName(docs.select("doc_id", F.lit(0).cast("long").alias("w")))
    s = found.groupBy("doc_id").agg((F.sum("w") / 100).alias("raw")).withColumn("s", F.tanh(F.col("raw") / 3))
    return s.select("doc_id", F.round("s", 4).alias("score"), F.when(F.col("s") >= 0.66, "ALTO").when(F.col("s") >= 0.33, "MEDIO").otherwise("BAJO").alias("risk_level"))


def fold_final(rule: Column, semantic: Column) -> Column:
    """RSK10 from the severities of rule and semantic matches in match order: sequential sums, as levels sit on exact boundaries."""
    of = lambda weights: lambda a, s: a + F.when(s == "HIGH", weights["HIGH"]).when(s == "MEDIUM", weights["MEDIUM"]).when(s == "LOW", weights["LOW"]).otherwise(0.0)
    r, m = F.aggregate(rule, F.lit(0.0), of(RULE_WEIGHTS)), F.aggregate(semantic, F.lit(0.0), of(SEMANTIC_WEIGHTS))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (r + F.least(m, r * 0.35)) / 7))


def final_level(score: Column) -> Column:
    return F.when(score >= 0.80, "ALTO").when(score >= 0.45, "MEDIO").otherwise("BAJO")


def _final(matches: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, s, ...): RSK10 before rounding, with further aggregates of a document's matches in the same pass."""
    ordered = F.sort_array(F.collect_list(F.struct("start", "end", "token", F.upper("severity").alias("severity"), (F.col("source") == "semantic").alias("semantic"))))
    part = lambda semantic: F.expr(f"transform(filter(m, x -> {'' if semantic else 'not '}x.semantic), x -> x.severity)")
    return matches.groupBy("doc_id").agg(ordered.alias("m"), *more).withColumn("s", fold_final(part(False), part(True))).drop("m")


def score_final(matches: DataFrame) -> DataFrame:
    """RSK10: (doc_id, score, risk_level)."""
    return _final(matches).select("doc_id", F.round("s", 6).alias("score"), final_level(F.col("s")).alias("risk_level"))


def _counts() -> list[Column]:
    return [F.count("*").alias("total"), *[F.count_if(F.upper("severity") == s).alias(s.lower()) for s in SEVERITIES], F.count_if(F.col("source") == "keyword").alias("keywords")]


def summary(matches: DataFrame, model: str | None = None) -> DataFrame:
    """RSK11, AGG06: counts by severity, all three always there, and of keyword matches; with ``model``, the label of the
    classifier in use, also that and whether there is one."""
    out = matches.groupBy("doc_id").agg(*_counts())
    return out if model is None else out.withColumns({"model": F.lit(model or "rules"), "semantic_used": F.lit(bool(model))})


def locate(matches: DataFrame, lines: DataFrame) -> DataFrame:
    """JON08: matches with page and line. One sweep per document over line starts and matches, instead of comparing each with each."""
    starts = lines.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("page", "line").alias("place"), F.lit(None).cast("struct<token:string,severity:string,source:string,reason:string,start:int,end:int>").alias("m"))
    points = matches.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["place"].dataType).alias("place"), F.struct("token", "severity", "source", "reason", "start", "end").alias("m"))
    w = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.unionByName(points).withColumn("place", F.last("place", ignorenulls=True).over(w)).where("kind = 1")
    return swept.select("doc_id", "m.*", "place.page", "place.line")


def found_matches(docs: DataFrame, lexicon: DataFrame, semantic: DataFrame | None = None, founded: bool = False) -> DataFrame:
    """All matches of canonical ``docs``, of ``semantic`` what RSK06 and RSK07 leave (see :func:`analyze`), before RSK08 merges those that overlap."""
    found = keyword_matches(docs, lexicon).unionByName(pattern_matches(docs))
    if semantic is None:
        return found
    found = found.unionByName(semantic)
    return found if founded else filter_semantic(found, docs)


def analyze(docs: DataFrame, lexicon: DataFrame, semantic: DataFrame | None = None, clean: bool = False, keep: Callable[[DataFrame], DataFrame] | None = None, founded: bool = False) -> tuple[DataFrame, DataFrame]:
    """The flagship: (matches with page and line, per document its score, level and counts). A text that is null gives no matches and level BAJO.

    ``docs`` are made canonical, unless ``clean`` says that they are (as they must be for ``semantic``). Page and line are
    found where a match is found, so nothing but matches is exchanged, once to merge overlaps and once to add up. With
    ``semantic`` the texts are read more than once: give them as :func:`canonical_table`.
    ``founded`` says that ``semantic`` has only what RSK06 and RSK07 leave, as :func:`semantic_matches` gives it; else the texts are joined to it for that.
    ``keep`` writes the matches down and reads them back for a caller of both results, who else finds them twice.
    """
    docs = docs if clean else canonical(docs)
    found = dedupe_overlaps(found_matches(docs, lexicon, semantic, founded))
    found = keep(found) if keep else found
    told = _final(found, *_counts()).withColumns({"score": F.round("s", 6), "risk_level": final_level(F.col("s"))})
    told = docs.select("doc_id").join(told.select("doc_id", "score", "risk_level", "total", "high", "medium", "low", "keywords"), "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "high", "medium", "low", "keywords")}
    located = found.select("doc_id", "token", "severity", "source", "reason", "start", "end", "page", "line")
    return located, told.withColumns(zero | {"score": F.coalesce("score", F.lit(0.0)), "risk_level": F.coalesce("risk_level", F.lit("BAJO"))})


def line_matches(located: DataFrame, lines: DataFrame, width: int = 512) -> DataFrame:
    """JON09: (doc_id, line, start, end, token, severity, source) of each line that a match reaches into, cut to the line and counted from its start.

    Lines and matches meet by the stretches of ``width`` characters that both touch, and each pair in the first of them.
    """
    first = lambda c: F.floor(F.col(c) / width)
    touched = lambda s, e: F.explode(F.sequence(first(s), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / width))).alias("part")
    a = lines.select("doc_id", F.col("line").alias("at_line"), F.col("start").alias("l0"), F.col("end").alias("l1")).where("l1 > l0").select("*", touched("l0", "l1"))
    b = located.where("end > start").select("doc_id", "start", "end", "token", "severity", "source").select("*", touched("start", "end"))
    low, high = F.greatest("start", "l0"), F.least("end", "l1")
    pairs = a.join(b, ["doc_id", "part"]).where((high > low) & (F.col("part") == F.floor(low / width)))
    return pairs.select("doc_id", F.col("at_line").alias("line"), (low - F.col("l0")).alias("start"), (high - F.col("l0")).alias("end"), "token", "severity", "source")


def snippets(located: DataFrame, docs: DataFrame, most: int = 24) -> DataFrame:
    """RSK16: what stands around each match, from ``from`` to ``to``, one for each canonical token, page and line, the first ``most`` of a document in match order.

    A match without offsets is looked for by its token, whatever its accents and blanks; one that is not found goes.
    """
    plain = F.lower(T.ascii_fold(F.regexp_replace("text", r"\s", " ")))
    at = F.instr(plain, F.lower(T.ascii_fold(F.regexp_replace(F.trim("token"), r"\s+", " ")))) - 1
    bare = located.where("start is null or end is null").where(F.trim("token") != "").join(docs.select("doc_id", "text"), "doc_id").withColumn("start", at).where("start >= 0")
    found = located.where("start is not null and end is not null").unionByName(bare.withColumn("end", F.col("start") + F.length(F.trim("token"))).select(located.columns))
    found = found.withColumn("canonical", T.canonical_token(F.col("token")))
    one = found.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "canonical", "page", "line").orderBy("start", "end", "token", "source"))).where("n = 1")
    one = one.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", "token", "source"))).where(F.col("n") <= most)
    left, right = T.context(F.col("text"), F.col("start"), F.col("end"))
    one = one.join(docs.select("doc_id", "text"), "doc_id").withColumns({"from": F.col("start") - F.length(left), "to": F.col("end") + F.length(right)})
    return one.withColumn("fragment", F.trim(F.expr("substring(text, from + 1, to - from)"))).drop("text")


def snippet_matches(snips: DataFrame, located: DataFrame) -> DataFrame:
    """JON10: (doc_id, n, start, end, token) of the matches in a snippet's stretch that look like the snippet's own: semantic ones in
    a semantic one, else rules of the same severity. They are cut to the stretch and counted from its start; a
    match without offsets is in it if its token is.

    A document has a bounded number of snippets, so its matches meet those and not each other.
    """
    kind = lambda: F.when(F.col("source") == "semantic", "semantic").otherwise(F.upper("severity"))
    s = snips.select("doc_id", "n", F.col("from").alias("s0"), F.col("to").alias("s1"), "fragment", kind().alias("kind"))
    m = located.select("doc_id", "start", "end", "token", kind().alias("kind"))
    placed, low, high = F.col("start").isNotNull() & F.col("end").isNotNull(), F.greatest("start", "s0"), F.least("end", "s1")
    said = (F.trim("token") != "") & F.contains(F.lower(T.ascii_fold(F.col("fragment"))), F.lower(T.ascii_fold(F.trim("token"))))
    cut = lambda c: F.when(placed, c - F.col("s0"))
    return s.join(m, ["doc_id", "kind"]).where((placed & (high > low)) | (~placed & said)).select("doc_id", "n", cut(low).alias("start"), cut(high).alias("end"), "token")


def token_frequency(located: DataFrame) -> DataFrame:
    """RSK17, AGG07: places (page and line) of each canonical token."""
    return located.groupBy("doc_id", T.canonical_token(F.col("token")).alias("canonical")).agg(F.countDistinct("page", "line").alias("places"))


def token_style(matches: DataFrame) -> DataFrame:
    """RSK18: of a token's matches a semantic one wins, then the higher severity."""
    rank = F.array_position(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.upper("severity"))
    best = matches.groupBy("doc_id", T.canonical_token(F.col("token")).alias("canonical")).agg(F.max(F.struct((F.col("source") == "semantic").alias("semantic"), rank.alias("rank"))).alias("b"))
    return best.select("doc_id", "canonical", "b.semantic", F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), F.col("b.rank").cast("int")).alias("severity"))


def match_density(matches: DataFrame, docs: DataFrame) -> DataFrame:
    """RSK20, AGG13: length of the distinct canonical tokens over the text's, at most 1.

    Matches that :func:`dedupe_overlaps` merges have one canonical token, so it gives the same before and after. Of the texts only lengths are exchanged.
    """
    tokens = matches.select("doc_id", T.canonical_token(F.col("token")).alias("c")).distinct().groupBy("doc_id").agg(F.sum(F.length("c")).alias("n"))
    sizes = docs.select("doc_id", F.length("text").alias("size"))
    return sizes.join(tokens, "doc_id").select("doc_id", F.round(F.least(F.lit(1.0), F.col("n") / F.greatest("size", F.lit(1))), 6).alias("density"))


_RUNS = "array<struct<start:int,end:int,source:string,severity:string>>"


def _painted(groups: list) -> list:
    rank = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}

    def one(spans: list) -> list[dict]:
        """A sweep over the spans' borders; the best open span is on top of a heap, ended ones go when they come up."""
        best = sorted(spans, key=lambda x: (x["source"] != "semantic", rank.get(x["severity"], 0), x["end"] - x["start"], -x["start"], x["token"]), reverse=True)
        begins = sorted((x["start"], k) for k, x in enumerate(best))
        out, heap, at = [], [], 0
        cuts = sorted({b for x in best for b in (x["start"], x["end"])})
        for low, high in zip(cuts, cuts[1:], strict=False):
            while at < len(begins) and begins[at][0] <= low:
                heapq.heappush(heap, begins[at][1])
                at += 1
            while heap and best[heap[0]]["end"] <= low:
                heapq.heappop(heap)
            if not heap:
                continue
            top = best[heap[0]]
            if out and out[-1]["end"] == low and (out[-1]["source"], out[-1]["severity"]) == (top["source"], top["severity"]):
                out[-1]["end"] = high
            else:
                out.append({"start": low, "end": high, "source": top["source"], "severity": top["severity"]})
        return out

    return list(map(one, groups))


def highlight_spans(matches: DataFrame) -> DataFrame:
    """RSK19, SRT10: runs of text painted by one match each; rules go over semantic ones, then severity, length and place decide. A group is one document's matches."""
    spans = matches.where("end > start").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "source", F.upper("severity").alias("severity"), "token")).alias("m"))
    return spans.select("doc_id", F.inline(over_slices(_painted, _RUNS)("m")))


def weak_labels(located: DataFrame, docs: DataFrame) -> DataFrame:
    """RSK21: training rows (doc_id, text, severity, source, reason, page, line), the text being the match's own stretch or its token."""
    stretch = F.coalesce(F.nullif(F.trim(F.expr("substring(text, start + 1, end - start)")), F.lit("")), F.trim("token"))
    return located.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", stretch.alias("text"), "severity", "source", "reason", "page", "line").where("text <> ''")
