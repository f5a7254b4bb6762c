"""Information-theoretic sanitisation of personal data.

Base spans are found by fixed patterns in every whole text. They are the protected entities. The corpus then says how
strongly other terms give them away: for a term ``t`` and an entity ``e``, the pointwise mutual information
``log2(N n(t,e) / (n(t) n(e)))`` is compared with the information content ``log2(N / n(e))`` of the entity. All counts
are of whole documents, ``N`` of all; a term counts where it stands outside base spans, in ``n(t)`` and ``n(t,e)`` alike,
as inside one it is not there to be read once the span is masked. The quotient is the disclosure: 1 means that who reads
the term knows the entity. In a large corpus it is high for every rare term, so the share of the term's documents that
hold the entity, ``P(e|t)``, must be ``SURE`` at least too. With ``SUPPORT`` families of texts at least that hold both (a
family is a class of near-duplicates: five-word shingles, similarity 0.8; copies prove nothing), a term at
``GENERALISE`` or more for some entity is replaced by its kind, and one at ``REMOVE`` or more is cut out, at every
place in every document, whether the entity stands there too or not. Base spans stay as they are found; a term that
touches one is part of it, and terms of one or two characters stay.

Four passes over the texts at most, and one if no entity has ``SUPPORT`` different texts. The first finds base spans and
entities. The second takes the terms of texts that hold such an entity, each text once; terms with too few of these
texts go before they are paired with the entities. The third counts the terms in question over all documents, the
fourth finds their places. Near-duplicates are searched only among the texts of pairs that pass all else. Bit tables of
fixed size keep other texts and terms out (false positives only cost time, the joins are exact). A frequent entity or
term is summed before it is shuffled. Entities of the same texts are counted as one (a list of addresses is one
entity), and the pairs of a long text are dealt out in blocks before they are made.

Nulls and edges: a null text is empty and has no spans; null ids are kept as they are; rows with equal id and text get
equal answers; a span never overlaps another of its kind; an empty table gives an empty result; other columns are only
passed on by ``sanitise``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays, minhash
from .order import stored
from .quality import KIND
from .terms import TABLE_BITS, bit_table, term_hashes

SUPPORT = 3
SURE = 0.5
SLICE = 1024
GENERALISE, REMOVE = 0.6, 0.85
KINDS = ("email", "ip", "card", "phone", "term")

#: The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a later start in a run of digits fares no better
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part and a domain: the local part is the whole run of its signs before an ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in _LOCAL_SIGNS):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(sum(divmod(2 * int(x), 10)) for x in back[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all base spans, by start and then kind; code points, end exclusive."""
    out = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _covered(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans (sorted by start) cover together."""
    starts, ends = [], []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


SCAN = ("doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
        "entities array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row, and its different entities (hashed)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in arrays.runs(batch):
                rows, named = [], []
                for text in part.column(2).to_pylist():
                    spans = base_spans(text or "")
                    said = ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)
                    kinds = [s[2] for s in spans]
                    rows.append((*(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(said.encode()).hexdigest(), said))
                    named.append(sorted({f"{kind}:{text[a:b]}" for a, b, kind in spans}))
                ids = iter(term_hashes([e for own in named for e in own]).tolist())
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)),
                     pa.array([sorted({next(ids) for _ in own}) for own in named], pa.list_(pa.int64()))],
                    [x.split()[0] for x in SCAN.split(", ")])
    return _keyed(docs).mapInArrow(run, SCAN)


def _hits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a table of ``bit_table``."""
    place = (arrays.mix(h.view(np.uint64)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[place >> 3] >> (place & 7)) & 1 == 1


def _terms(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end (code points) of every term of three characters or more in a slice of texts."""
    low = arrays.LOWER[data]
    starts, ends, first = arrays.split(at, (KIND[low] == 1).astype(np.uint8))
    signs = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    x, y = signs[starts] - signs[at[row]], signs[ends] - signs[at[row]]
    long = y - x >= 3
    return arrays.hashes(low, starts[long], ends[long]).view(np.int64), row[long], x[long], y[long]


def _free(text: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the places (x, y) of a text touch no base span."""
    starts, ends = map(np.array, _covered(base_spans(text)))
    if not len(starts):
        return np.ones(len(x), bool)
    k = np.searchsorted(starts, y) - 1
    return (k < 0) | (ends[k] <= x)


def _free_hits(texts: pa.Array, at: np.ndarray, data: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, and hashes, starts and ends of the terms outside base spans whose bit is set, for rows that have any."""
    h, row, x, y = _terms(at, data)
    hit = _hits(table, h)
    h, row, x, y = h[hit], row[hit], x[hit], y[hit]
    cut = np.searchsorted(row, np.arange(len(at)))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        own = slice(cut[k], cut[k + 1])
        free = _free(texts[k].as_py(), x[own], y[own])
        yield k, h[own][free], x[own][free], y[own][free]


def _held_terms(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """text_key and the different terms outside base spans of each text in ``texts`` (text_key), once."""
    table = bit_table(texts.select(F.col("text_key").alias("term")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at_once = np.unique(batch.column(0).to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(at_once[_hits(table, keys)])))
            for part, at, data in arrays.runs(batch):
                h, row, x, y = _terms(at, data)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = [np.unique(h[a:b][_free(part.column(1)[k].as_py() or "", x[a:b], y[a:b])])
                       for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.int64()))], ["text_key", "terms"])
    found = _keyed(docs).select("text_key", "text").mapInArrow(run, "text_key long, terms array<long>")
    return found.groupBy("text_key").agg(F.first("terms").alias("terms"))


def _counted(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n_term, the number of documents that hold it outside base spans, for the hashes in ``terms``.

    Each task adds up what it has read and sends one row for each term.
    """
    table = bit_table(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = [term]
            for part, at, data in arrays.runs(batch):
                held += [np.unique(h) for _, h, _, _ in _free_hits(part.column(0), at, data, table)]
            found, back = np.unique(np.concatenate(held), return_inverse=True)
            count = np.bincount(back, np.concatenate([count, np.ones(len(back) - len(term))]), len(found)).astype(np.int64)
            term = found
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count)], ["term", "n"])
    held = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return held.join(terms, "term", "left_semi")


def _blocks(held: DataFrame, terms: DataFrame) -> DataFrame:
    """text_key, n, entities and terms of each text in ``held``, only those in ``terms``, in blocks of SLICE by SLICE."""
    table = bit_table(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, who, what = [], [], []
            for k, (e, t) in enumerate(zip(batch.column(2), batch.column(3))):
                e, t = (np.asarray(x.values) for x in (e, t))
                t = t[_hits(table, t)]
                for i in range(0, len(e), SLICE):
                    for j in range(0, len(t), SLICE):
                        of.append(k)
                        who.append(e[i:i + SLICE])
                        what.append(t[j:j + SLICE])
            at = pa.array(of, pa.int32())
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (who, what)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *lists],
                                             ["text_key", "n", "entities", "terms"])
    return held.mapInArrow(run, "text_key long, n long, entities array<long>, terms array<long>")


def _exploded(blocks: DataFrame) -> DataFrame:
    return (blocks.select("text_key", "n", "terms", F.explode("entities").alias("entity"))
            .select("text_key", "n", "entity", F.explode("terms").alias("term")))


def _families(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """text_key and family (near-duplicate class) of each text in ``texts`` (text_key)."""
    table = bit_table(texts.select(F.col("text_key").alias("term")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at_once = np.unique(batch.column(0).to_numpy(), return_index=True)
            yield batch.take(pa.array(np.sort(at_once[_hits(table, keys)])))
    whole = _keyed(docs).select(F.col("text_key").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")
    wanted = stored(whole.join(texts.select(F.col("text_key").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "family-texts")
    return minhash.near_duplicates(wanted).select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("family"))


def disclosures(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """entity, term and disclosure of every pair at or above GENERALISE; of entities with the same texts, one.

    A term occurs in at least as many documents as hold it together with some
    entity, which bounds its disclosure from above. Only pairs whose bound is
    high enough are counted over the corpus.
    """
    total = float(seen.count())
    texts = stored(seen.where(F.size("entities") > 0).groupBy("text_key").agg(
        F.first("entities").alias("entities"), F.count(F.lit(1)).alias("n")), "entity-texts")
    said = texts.select("text_key", "n", F.explode("entities").alias("entity"))
    # Entities with the same texts have the same counts with every term; two sums of hashes name a set of texts.
    named = said.groupBy("entity").agg(
        F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"), F.expr("bit_xor(xxhash64(text_key, 1))").alias("one"),
        F.expr("bit_xor(xxhash64(text_key, 2))").alias("two")).where(F.col("texts") >= SUPPORT)
    entities = stored(named.groupBy("n_entity", "texts", "one", "two").agg(F.min("entity").alias("entity")).select("entity", "n_entity"), "entities")
    # Made without Python: rows of the session's own would start a second daemon with workers on every executor.
    none = docs.sparkSession.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in (
        ("entity", "long"), ("term", "long"), ("disclosure", "double"))))
    if entities.isEmpty():
        return none
    asked = stored(said.join(entities, "entity").groupBy("text_key", "n").agg(
        F.collect_list("entity").alias("entities")), "asked")  # the entities of one text
    held = stored(asked.join(_held_terms(docs, asked), "text_key").select("text_key", "n", "entities", "terms"), "held-terms")
    near = stored(held.select("n", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("n").alias("n_near"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
        .select("term", "n_near"), "near-terms")
    both = _exploded(_blocks(held, near).repartition(F.xxhash64("text_key", "entities", "terms"))).groupBy("entity", "term").agg(
        F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts"))

    def disclosure(n_term: str):
        content = F.log2(F.lit(total) / F.col("n_entity"))
        mutual = F.log2(F.lit(total) * F.col("both") / (F.col(n_term) * F.col("n_entity")))
        return F.when((content > 0) & (F.col("both") >= SURE * F.col(n_term)), mutual / content).otherwise(0.0)
    pairs = stored(both.where(F.col("texts") >= SUPPORT)
                   .join(entities, "entity").join(near, "term").where(disclosure("n_near") >= GENERALISE), "pairs")
    terms = _counted(docs, pairs.select("term").distinct())
    pairs = stored(pairs.join(terms, "term").withColumn("disclosure", disclosure("n_term")).where(
        F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"), "disclosing")
    if pairs.isEmpty():
        return none
    together = stored(_exploded(_blocks(held, pairs.select("term").distinct())).join(pairs, ["entity", "term"]).select(
        "text_key", "entity", "term"), "together")
    families = _families(docs, together.select("text_key").distinct())
    supported = together.join(families, "text_key").select("entity", "term", "family").distinct().groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("families")).where(F.col("families") >= SUPPORT)
    return pairs.join(supported.drop("families"), ["entity", "term"])


def struck(docs: DataFrame, telling: DataFrame) -> DataFrame:
    """_id, _key and ``terms`` (start, end, removed) of every row with terms in ``telling`` (term, removed)."""
    table = bit_table(telling)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, at, data in arrays.runs(batch):
                found = list(_free_hits(part.column(2), at, data, table))
                of = pa.array(np.concatenate([np.zeros(0, np.int64), *(np.full(len(h), k) for k, h, _, _ in found)]))
                h, x, y = (np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in (1, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(of), part.column(1).take(of), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(h)],
                    ["_id", "_key", "start", "end", "term"])
    found = _keyed(docs).mapInArrow(run, "_id long, _key long, start int, end int, term long")
    return (found.join(telling, "term").groupBy("_id", "_key", "start", "end").agg(F.max("removed").alias("removed"))
            .groupBy("_id", "_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("terms")))


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, counts, base_sha256, base, and ``terms``: (start, end, removed) of disclosing terms, by start."""
    seen = stored(scan(docs), "spans-of-rows")
    telling = stored(disclosures(docs, seen).groupBy("term").agg((F.max("disclosure") >= REMOVE).alias("removed")), "telling")
    if telling.isEmpty():
        return seen.drop("entities").withColumn("terms", F.lit(None).cast("array<struct<start: int, end: int, removed: boolean>>"))
    cut = struck(docs, telling)
    return seen.join(cut, (seen["text_key"] == cut["_key"]) & seen["doc_id"].eqNullSafe(cut["_id"]), "left").drop(
        "_id", "_key", "entities")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digests of base spans, and all spans, for every row."""
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""),
                       lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"),
                                          F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("kind"), x.alias("said")))
    more = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"),
                                                   F.lit(len(KINDS)).cast("long").alias("kind"),
                                                   F.concat_ws(":", F.lit("term"), t["start"], t["end"]).alias("said")))
    order = F.array_sort(F.concat(base, more), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                         .when(x["kind"] < y["kind"], -1).when(x["kind"] > y["kind"], 1).otherwise(0))
    return found_spans(docs).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("terms").isNull(), F.col("base")).otherwise(
            F.array_join(F.transform(order, lambda x: x["said"]), ",")).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"))


def _masked(text: str, base: str, terms: list[dict] | None) -> str:
    cuts = [(int(a), int(b), f"<{kind.upper()}>") for kind, a, b in (x.split(":") for x in base.split(",") if x)]
    for t in [] if terms is None else terms:
        word = text[t["start"]:t["end"]]
        cuts.append((t["start"], t["end"], "" if t["removed"] else "<NUMBER>" if word.isdigit() else "<WORD>"))
    out, at = [], 0
    for a, b, mark in sorted(cuts):
        if b <= at:  # inside a span of another kind
            continue
        out += [text[at:max(a, at)], mark]
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with masked texts; ``n_chars``, if there is one, follows. All other columns stay.

    Most texts hold nothing and are not moved: a bit table of fixed size over
    the texts with spans leaves only theirs to an exact join. That join is never
    a broadcast: in one stage, marking and masking would take two Python workers
    for each task, and all of them live on.
    """
    found = found_spans(docs).where((F.col("base") != "") | F.col("terms").isNotNull()).select(
        F.col("doc_id").alias("_id"), "text_key", "base", "terms").dropDuplicates(["_id", "text_key"])
    found = stored(found, "spans")
    table = bit_table(found.select(F.col("text_key").alias("term")))

    @F.arrow_udf("boolean")
    def marked(keys: pa.Array) -> pa.Array:
        return pa.array(_hits(table, keys.to_numpy(zero_copy_only=False)))

    @F.arrow_udf("string")
    def masked(text: pa.Array, base: pa.Array, terms: pa.Array) -> pa.Array:
        return pa.array((_masked(t.as_py() or "", b.as_py(), s.as_py()) if b.is_valid else t.as_py()
                         for t, b, s in zip(text, base, terms)), pa.string())
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    split = marked(key)
    rows = docs.where(split)
    joined = rows.join(found.hint("merge"), (key == found["text_key"]) & rows["doc_id"].cast("long").eqNullSafe(found["_id"]), "left")
    new = F.when(F.col("base").isNull(), F.col("text")).otherwise(masked("text", "base", "terms"))
    columns = [F.col(c) if c not in ("text", "n_chars") else new.alias("text") if c == "text"
               else F.when(F.col("base").isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long")).alias("n_chars")
               for c in docs.columns]
    return docs.where(~split).withColumns({"n_chars": F.col("n_chars").cast("long")} if "n_chars" in docs.columns else {}).unionByName(
        joined.select(*columns))
