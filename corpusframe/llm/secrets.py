"""Secret scans with linking of credentials that come in parts.

Strong candidates (key assignments, access identifiers, long hexadecimal strings) are reported by
themselves. Weak ones are common in clean text and are reported only together: identifiers of users and
clients, access identifiers too short to stand alone (``ident``), tokens of letters and digits, key assignments
with a short value (``key``: after ``=``, or with a digit in it, so that ``token: words`` of prose is none) and
endpoints are joined as intervals within a scope (so many characters from end to start), and a weak candidate
counts if the parts that complete it are in its scope:

* a token or short key needs an identifier (of any kind), an identifier a secret (strong or weak),
* an endpoint needs an identifier and a secret.

The join runs on the sorted starts of one text's candidates. Texts are independent rows: nothing is
shuffled, and a task holds one batch of texts.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "user", "token", "endpoint", "key", "ident")
#: What a kind is in a credential.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "user": "id", "token": "secret", "endpoint": "place", "key": "secret", "ident": "id"}
NEEDS = {"token": ("id",), "key": ("id",), "user": ("secret",), "ident": ("secret",), "endpoint": ("id", "secret")}
#: Characters between the parts of one credential.
SCOPE = 200
#: Characters of a value or identifier from which a strong candidate stands alone, and of the weak ones.
LONG_VALUE, LONG_ACCESS, SHORT_VALUE, SHORT_ACCESS = 12, 18, 4, 8


def _either_case(word: str) -> str:
    """ASCII letters in either case, and no others that fold to them."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_USERS = "|".join(map(_either_case, ("user_?name", "user_?id", "user", "login", "client_?id", "account_?id", "access_?key_?id")))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
USER = re.compile(rf"""(?:{_USERS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{{3,}})""")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]*://[^\s\"'<>]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong candidates, leftmost and without overlap per kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LONG_VALUE]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LONG_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _random_looking(s: str) -> bool:
    """Digits and letters of both cases; of one case only where nothing parts them, so that slugs and paths are none."""
    lower, upper = any(c.islower() for c in s), any(c.isupper() for c in s)
    return any(c.isdigit() for c in s) and (lower and upper or (lower or upper) and s.rstrip("=").isalnum())


def _short_key(m: re.Match) -> bool:
    value = m[2]
    if not SHORT_VALUE <= len(value) < LONG_VALUE:
        return False
    return "=" in m[0][len(m[1]):m.start(2) - m.start()] or any(c.isdigit() for c in value)


def weak_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak candidates outside the strong ones."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "user") for m in USER.finditer(text)]
        found += [(m.start(), m.end(), "key") for m in ASSIGN.finditer(text) if _short_key(m)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "ident") for m in ACCESS.finditer(text) if SHORT_ACCESS <= m.end() - m.start() < LONG_ACCESS]
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    # tokens count only beside an identifier
    if any(ROLE[k] == "id" for _, _, k in taken + found):
        found += [(m.start(), m.end(), "token") for m in TOKEN.finditer(text) if _random_looking(m[0])]
    taken = sorted(taken)
    ends, far = [], 0  # the furthest end so far, so that a long span hides what it covers
    for _, b, _ in taken:
        far = max(far, b)
        ends.append(far)
    starts = [a for a, _, _ in taken]
    def free(a, b):
        i = bisect.bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a
    return [x for x in found if free(x[0], x[1])]


def link(strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """The weak candidates whose complements lie within ``scope``."""
    by_role = {}
    for a, b, k in sorted(strong + weak):
        by_role.setdefault(ROLE[k], ([], []))
        starts, ends = by_role[ROLE[k]]
        starts.append(a)
        ends.append(max(b, ends[-1]) if ends else b)
    def near(a, b, role):
        starts, ends = by_role.get(role, ((), ()))
        i = bisect.bisect_right(starts, b + scope)
        return i > 0 and ends[i - 1] >= a - scope
    return [x for x in weak if all(near(x[0], x[1], role) for role in NEEDS[x[2]])]


def spans_of(text: str, scope: int = SCOPE) -> tuple[list, list]:
    """(strong spans, linked spans), each by start, then kind."""
    order = lambda x: (x[0], KINDS.index(x[2]))
    strong = base_spans(text)
    return sorted(strong, key=order), sorted(link(strong, weak_spans(text, strong), scope), key=order)


def _say(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans, mark: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


MADE = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()),
        ("redacted", T.StringType())]


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE, with_text: bool = True) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, spans and redacted (the text with every span masked).

    ``spans`` lists all spans as kind:start:end in code points, by start, then kind; the digest is that of
    the strong ones alone. Input columns of these names are replaced. A null text has no spans and stays
    null in ``redacted``; every row is kept, repeated rows too. ``with_text=False`` leaves ``redacted`` null.
    """
    names = [n for n, _ in MADE]
    own = [f for f in docs.schema.fields if f.name not in names]
    source = docs.select(*[F.col(f"`{f.name}`") for f in own], F.col(f"`{text}`").alias("__text"))

    def run(batches):
        for batch in batches:
            got = {n: [] for n in names}
            for t in batch.column(batch.num_columns - 1).to_pylist():
                strong, linked = spans_of(t or "", scope)
                kinds = [k for _, _, k in strong]
                for k in ("assign", "access", "hex"):
                    got[f"n_{k}"].append(kinds.count(k))
                got["base_sha256"].append(hashlib.sha256(_say(strong).encode()).hexdigest())
                every = sorted(strong + linked, key=lambda x: (x[0], KINDS.index(x[2])))
                got["spans"].append(_say(every))
                got["redacted"].append((redact(t, every) if every else t) if with_text and t is not None else None)
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols += [pa.array(got[n], pa.int64() if n.startswith("n_") else pa.string()) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *names])

    return source.mapInArrow(run, T.StructType(own + [T.StructField(n, k) for n, k in MADE]))


def redact_documents(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The documents with every secret masked; the columns of ``docs``. ``n_chars`` follows the text."""
    found = scan(docs, "text", scope)
    fresh = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return found.select(*[fresh.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
