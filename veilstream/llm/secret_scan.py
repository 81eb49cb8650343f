"""Secret scan: rules found through a trigram inverted index and verified by their regular expressions.

Each rule's pattern gives a Boolean trigram query.  A batch of texts is indexed for the trigrams that any rule
asks for, postings are intersected and united as the queries say, and only the texts left are searched with the
pattern; a rule without mandatory trigrams searches every text.

Defined results: null counts as empty text; matches of one rule do not overlap (leftmost first) and those that fail
the rule's length are dropped; offsets count code points; equal texts give equal spans; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from veilstream.llm.trigram_index import TrigramIndex, query, trigrams

BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: re.Pattern
    least: int = 1
    group: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.pattern.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


# The base rules, and public formats of access tokens.
BASE = [
    Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    Rule("hex", re.compile(r"[0-9a-f]{24,}")),  # as runs of 24 and more
]
MORE = [
    Rule("temporary_access", re.compile(r"ASIA[A-Z0-9]{16,}")),
    Rule("github", re.compile(r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{50,}")),
    Rule("gitlab", re.compile(r"glpat-[A-Za-z0-9_-]{20,}")),
    Rule("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    Rule("google", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    Rule("payment", re.compile(r"[rs]k_live_[A-Za-z0-9]{16,}")),
    Rule("web_token", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
    Rule("private_key", re.compile(r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----")),
    Rule("bearer", re.compile(r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", re.I | re.A)),
    Rule("url_login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]{3,}@[A-Za-z0-9.-]+")),
]
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.queries = [query(r.pattern) for r in rules]
        self.wanted = set().union(*(trigrams(q) for q in self.queries))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text, (start, rule number, end) of all spans, in order."""
        index = TrigramIndex([x.encode() for x in texts], self.wanted)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, q) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in index.ask(q).tolist():
                out[i] += [(a, n, b) for a, b in rule.spans(texts[i])]
        return [sorted(x) for x in out]


def _batches(texts: list[str]):
    """Ranges of texts of bounded size."""
    first = size = 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= BATCH_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end, text), for every row of docs."""

    def run(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            spans = [x for a, b in _batches(texts) for x in scanner.scan(texts[a:b])]
            rows = [[{"kind": rules[n].kind, "start": a, "end": b, "text": t[a:b]} for a, n, b in own] for t, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long,text:string>>")


def digest(docs: DataFrame) -> DataFrame:
    """Per row of docs: counts of the base kinds, the hash of their spans, and all spans as a string."""
    base = [r.kind for r in BASE]
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

    def run(batches):
        for batch in batches:
            rows = []
            for doc, own in zip(batch["doc_id"].to_pylist(), batch["secrets"].to_pylist(), strict=True):
                names = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in own]
                first = ",".join(s for k, s in names if k in base)
                rows.append((doc, *(sum(k == b for k, _ in names) for b in base), hashlib.sha256(first.encode()).hexdigest(), ",".join(s for _, s in names)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return find_secrets(docs).mapInArrow(run, schema)
