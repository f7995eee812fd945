"""Secret scans with an incremental blob ledger.

Every version of every text is a blob named by its SHA-256.  The ledger holds, for each blob, the
rule versions it has been scanned with and what they found; a scan reads only the blobs that lack a
rule version, once each however many paths have them, and findings are joined back to all paths.

:class:`Ledger` keeps it as a table that runs append to; one path may have any number of versions, a row each.

Null texts are the empty blob.  Repeated rows and copies share a blob; every row gets the result.
Spans count code points; the end is exclusive.  Every rule takes time linear in the text, however
long it is and however often a rule's beginning occurs in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm import storage
from tessellum.llm.spans import replaced
from tessellum.llm.textcore import bounded

SPANS = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``hints``: lower-case strings one of which any match contains; none: always try."""

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    least: int = 0
    group: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_JWT_PART = re.compile(r"[A-Za-z0-9_-]+")


def _pem_spans(text: str) -> Iterator[tuple[int, int]]:
    """From a first line to the next last line.  Without a last line ahead there is nothing more to find."""
    begin = _PEM[0].search(text)
    while begin and (end := _PEM[1].search(text, begin.end())):
        yield begin.start(), end.end()
        begin = _PEM[0].search(text, end.end())


def _jwt_spans(text: str) -> Iterator[tuple[int, int]]:
    """Three runs joined by dots.  All starts inside one run go on alike, so its first one stands for them."""
    last: list[tuple[int, int]] = []
    for m in _JWT_PART.finditer(text):
        last = [*last[-2:], m.span()]
        if len(last) == 3:
            (a, b), (c, d), (e, f) = last
            if c == b + 1 and e == d + 1 and text[b] == text[d] == "." and d - c >= 8 and f - e >= 8:
                start = text.find("eyJ", a, b)
                if start >= 0 and b - start >= 11:
                    yield start, f
                    last = []


#: Rules whose pattern, tried at every place, could take quadratic time; the same matches by one walk.
_WALKS = {"pem": _pem_spans, "jwt": _jwt_spans}

#: The first three are the base kinds; matches whose group is shorter than ``least`` are dropped.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "api"), 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), 20),
    Rule("hex", 1, r"[0-9a-f]+", (), 24),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", ("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("bearer", 1, r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*", ("bearer",)),
)
BASE_KINDS = ("assign", "access", "hex")

_WALKED = {r.kind: r.pattern for r in RULES if r.kind in _WALKS}

# A run of at least 24 hexadecimal digits can be searched for directly: shorter runs are dropped anyway.
_RUN = {"[0-9a-f]+": "[0-9a-f]{%d,}"}


def find_spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """(rule, start, end) of all matches, leftmost and non-overlapping for each rule."""
    low = text.lower()
    out = []
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        if rule.pattern == _WALKED.get(rule.kind):
            out += [(rule.name, a, b) for a, b in _WALKS[rule.kind](text)]
            continue
        pattern = _RUN[rule.pattern] % rule.least if rule.pattern in _RUN else rule.pattern
        for m in re.compile(pattern, re.ASCII).finditer(text):
            if len(m[rule.group]) >= rule.least:
                out.append((rule.name, m.start(), m.end()))
    return out


def _scanner(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}
    schema = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = batch.column("rules").to_pylist()
            found = []
            for text, names in zip(batch.column("text"), todo, strict=True):
                spans = find_spans(text.as_py() or "", tuple(by_name[n] for n in names))
                found.append([{"rule": r, "start": a, "end": b} for r, a, b in spans])
            yield pa.record_batch([batch.column("blob").cast(pa.binary()), pa.array(todo, schema.field("rules").type), pa.array(found, schema.field("spans").type)], schema=schema)

    return run


def with_blob(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the content address of each text in column blob."""
    return docs.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))


def scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for the blobs of ``docs`` that lack a rule version; append them to the ledger."""
    paths = with_blob(bounded(docs).select(F.col(id_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    names = F.array(*(F.lit(r.name) for r in rules))
    # Only addresses are grouped; the text of one path of each unseen blob follows by a join.
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        first = first.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0).drop("seen")
    else:
        first = first.withColumn("rules", names)
    wanted = first.select(F.col("blob").alias("w_blob"), F.col("path").alias("w_path"), "rules")
    texts = paths.join(wanted, F.col("path").eqNullSafe(F.col("w_path")) & (F.col("blob") == F.col("w_blob"))).select("blob", "text", "rules")
    scanned = texts.mapInArrow(_scanner(rules), LEDGER)
    # A row that repeats its id and text is scanned again; one result stays.
    return scanned.groupBy("blob").agg(F.first("rules").alias("rules"), F.first("spans").alias("spans"))


class Ledger:
    """A ledger stored at ``path``, which several runs extend."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """(blob, rules, spans): what has been scanned so far."""
        where, files = storage.located(self.spark, self.path)
        if not files.exists(where):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> Ledger:
        """Scan what the ledger lacks of the texts of ``docs``, all versions of all paths, and append it.

        A run that is repeated after a loss appends nothing twice that was committed.
        """
        scan(docs, self.read(), id_col, text_col, rules).write.mode("append").parquet(self.path)
        return self

    def findings(self, docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
        """:func:`findings` of every row of ``docs``, whichever run scanned its blob."""
        return findings(docs, self.read(), text_col, name)


def _with_findings(docs: DataFrame, ledger: DataFrame, text_col: str) -> DataFrame:
    """(row, spans): each row of ``docs`` as a struct, and all the ledger knows about its blob."""
    known = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    # Kept apart from the aggregate, the join can split the paths of a blob that has very many.
    known = storage.table(known, "findings")
    rows = with_blob(docs.select(F.struct(*docs.columns).alias("row"), docs[text_col].alias("text"))).select("row", "blob")
    return rows.join(known, "blob", "left").select("row", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with everything the ledger knows about each row's blob in column ``name``, which replaces one of that name."""
    own = docs.drop(name)
    return _with_findings(own, ledger, text_col).select("row.*", F.col("spans").alias(name))


def ordered(spans: str, rules: tuple[Rule, ...] = RULES):
    """Strings kind:start:end by start, then kind in the order of ``rules``, as an array column."""
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    kind = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.kind))))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["rule"]].alias("order"), s["end"].alias("end"), kind[s["rule"]].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("label")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: Ledger | DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: counts of the base kinds, the digest of their spans, and all spans as text.

    Without a ``ledger`` a new one is kept among the session's intermediate tables; one that is a frame
    is read and not extended.
    """
    given = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    if isinstance(ledger, DataFrame):
        known = ledger.unionByName(scan(given, ledger, id_col, "text", rules))
    else:
        ledger = ledger or Ledger(docs.sparkSession, storage.place(docs.sparkSession, "ledger"))
        known = ledger.update(given, id_col, "text", rules).read()
    found = findings(given, known).select(id_col, ordered("spans", rules).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [_count(k) for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(F.array_join(F.transform(base, lambda s: s["label"]), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", lambda s: s["label"]), ",").alias("spans"))


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; rows without findings stay as they are."""
    found = _with_findings(docs, scan(docs, None, id_col, text_col, rules), text_col)
    pieces = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    text = F.col("row").getField(text_col)
    cut = F.when(F.size("spans") > 0, replaced(text, pieces, mark)).otherwise(text)
    return found.select(F.col("row").withField(text_col, cut).alias("row")).select("row.*")
