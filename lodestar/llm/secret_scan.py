"""Secret scans: a keyword automaton finds where rules could match, anchored expressions run only there, checksums decide.

One Aho-Corasick pass over the lower-cased bytes of a text gives the places of
all rules' keywords. A rule's expression is tried at the place of its keyword,
anchored, and a rule may check what it matched: embedded CRC-32 of GitHub and
npm tokens, the head of a JSON web token. Card numbers are not looked for.
Runs of hexadecimal digits have no keyword; as any run of 16 covers one of each
16 places in turn, every sixteenth byte is looked at, and runs grow from there.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..workspace import spread

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc62(body: bytes) -> bytes:
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.encode()


def has_crc62(match: re.Match) -> bool:
    """The last six characters are the CRC-32, in base 62, of those before them without the prefix."""
    body = match.group(1)
    return _crc62(body[:-6]) == body[-6:]


def is_jwt(match: re.Match) -> bool:
    """The first part is the base64 of a JSON object that names an algorithm."""
    head = match.group().split(b".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(found, dict) and "alg" in found


@dataclass(frozen=True)
class Rule:
    """``pattern`` is tried where one of ``keywords`` (lower case) begins; ``valid`` has the last word.

    ``run``: where the pattern fails, it fails at each later place of the run that this matches there, too.
    """

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: Callable[[re.Match], bool] = lambda m: True
    run: re.Pattern | None = None


def _any_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: Kinds in the order in which spans of one start are listed.
BASE_RULES = (
    Rule(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile((_any_case("(?:password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").encode()),
        lambda m: m.end(1) - m.start(1) >= 12,
    ),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: m.end() - m.start() >= 18),
)
HEX_KIND, HEX_LEAST = "hex", 16
MORE_RULES = (
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), has_crc62),
    Rule("npm", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), has_crc62),
    Rule("jwt", ("eyj",), re.compile(rb"eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"), is_jwt, re.compile(rb"[A-Za-z0-9_-]+")),
    Rule("slack", ("xox",), re.compile(rb"xox[abposr]-[0-9]{8,}-[0-9A-Za-z-]{12,}")),
    Rule("stripe", ("sk_live_", "rk_live_"), re.compile(rb"[sr]k_live_[0-9A-Za-z]{20,}")),
    Rule("private_key", ("-----begin",), re.compile(rb"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,32}PRIVATE KEY-----")),
)
KINDS = (*(r.kind for r in BASE_RULES), HEX_KIND, *(r.kind for r in MORE_RULES))

_HEX_RUN = re.compile(rb"[0-9a-f]+")
_IS_HEX = np.zeros(256, bool)
_IS_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True


class Scanner:
    def __init__(self, rules: Iterable[Rule] = (*BASE_RULES, *MORE_RULES)) -> None:
        self.words = ahocorasick.Automaton()
        by_word: dict[str, list[Rule]] = {}
        for rule in rules:
            for word in rule.keywords:
                by_word.setdefault(word, []).append(rule)
        for word, own in by_word.items():
            self.words.add_word(word, (len(word), own))
        self.words.make_automaton()

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as in ``KINDS``; code points, end exclusive."""
        data = (text or "").encode()
        hits = [(end - n + 1, rule) for end, (n, own) in self.words.iter(data.lower().decode("latin-1")) for rule in own]
        spans, past = [], {}
        for start, rule in sorted(hits, key=lambda h: h[0]):
            if start < past.get(rule.kind, 0):  # within the last match of that kind
                continue
            match = rule.pattern.match(data, start)
            if match:
                past[rule.kind] = match.end()
                if rule.valid(match):
                    spans.append((rule.kind, start, match.end()))
            elif rule.run and (run := rule.run.match(data, start)):
                past[rule.kind] = run.end()
        spans += self._hex_runs(data)
        if len(data) != len(text or ""):
            chars = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80) if spans else None
            spans = [(kind, int(chars[start]) - 1, int(chars[end - 1])) for kind, start, end in spans]
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))

    @staticmethod
    def _hex_runs(data: bytes) -> Iterator[tuple[str, int, int]]:
        at = np.frombuffer(data, np.uint8)[HEX_LEAST - 1 :: HEX_LEAST]
        places = (np.nonzero(_IS_HEX[at])[0] + 1) * HEX_LEAST - 1
        if len(places):  # any run of 16 that covers the place also covers the place 8 before or 8 after
            whole = np.frombuffer(data + b" " * HEX_LEAST, np.uint8)
            places = places[_IS_HEX[whole[places - 8]] | _IS_HEX[whole[places + 8]]]
        past = 0
        for place in places.tolist():
            if place < past:
                continue
            start = place
            while start > past and _IS_HEX[data[start - 1]]:
                start -= 1
            past = _HEX_RUN.match(data, start).end()
            if past - start >= HEX_LEAST:
                yield HEX_KIND, start, past


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts have no spans; null ids and repeated rows come back as
    they are, and an empty table gives an empty result. Time and memory grow
    with the length of a text.
    """
    ship_package(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner().scan
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in scan(text.as_py())] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def redact(text: str | None, spans: Iterable[tuple[str, int, int]]) -> str | None:
    """Each span, joined with those that overlap it, becomes [SECRET]."""
    if text is None:
        return None
    out, past, last = [], 0, -1
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= last:
            out += [text[past:start], "[SECRET]"]
        last = past = max(last, end)
    return "".join([*out, text[past:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in text replaced, and n_chars, where there is one, as the text then has.

    All rows, repeated ones too, and all other columns stay, whatever their
    names; null texts stay null, and an empty table gives an empty result.
    """

    ship_package(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts):
        scan = Scanner().scan
        return texts.map(lambda t: None if t is None else redact(t, scan(t)))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of each row of ``documents``; what ``find_secrets`` says of nulls, repeats and empty tables holds."""
    found = find_secrets(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
