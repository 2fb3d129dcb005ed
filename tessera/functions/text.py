"""Scalar text functions as Column expressions; Arrow UDFs only where the JVM has no equivalent."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = "[A-Za-z0-9_]+"
#: Keys flattened first, those of them whose name isn't emitted, and identifiers that are skipped.
PRIORITY_KEYS = ("name", "description", "parameters", "arguments", "doc_arguments")
UNNAMED_KEYS = ("parameters", "arguments", "doc_arguments")
ID_KEYS = ("id", "tool_id", "query_id")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast builtin serves texts that are ASCII throughout. Null is empty."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def tokenize(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased; only A-Z are, so that case folding adds none; null has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda x: F.lower(x))


_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_TOKEN = re.compile(TOKEN)


def plain_tokens(text: str) -> list[str]:
    """What `tokenize` gives, for use inside of workers."""
    return _TOKEN.findall(text.translate(_ASCII_LOWER))


#: Bytes of tokens, A-Z lower-cased, and a space for every other one.
_CUT = bytes(b if _TOKEN.fullmatch(chr(b)) else 32 for b in (_ASCII_LOWER.get(b, b) for b in range(256)))


def term_counts(texts: list[str]) -> Counter:
    """Tokens of texts, as `tokenize` cuts them, as bytes with their counts, for use inside of workers."""
    n = Counter()
    for t in texts:
        n.update(t.encode().translate(_CUT).split())
    return n


def word_count(text: Column) -> Column:
    """Number of runs without white space, of any script's kind, as str.split counts them; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")), F.lit(0)).cast("long")


def id_prefix(id_: Column, mark: str = "_tool_") -> Column:
    return F.when(id_.contains(mark), F.regexp_extract(id_, f"^(.*){mark}", 1)).otherwise(F.lit("unknown"))


def excerpt(text: Column, most: int = 240) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most - 3), " [^ ]*$", ""), F.lit("...")))


def snake(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), F.lit("[a-z0-9]+"), F.lit(0)), "_")


def name_counterpart(a: Column, b: Column) -> Column:
    """Whether the shorter snake name (12 characters or more) is the longer one or its suffix after an underscore."""
    x, y = snake(a), snake(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (F.length(short) >= 12) & ((short == long) | long.endswith(F.concat(F.lit("_"), short)))


def _parts(v, out: list[str]) -> None:
    if v is None:
        return
    if isinstance(v, dict):
        first = [k for k in PRIORITY_KEYS if k in v]
        for k in [*first, *(k for k in v if k not in first)]:
            if str(k).lower() in ID_KEYS:
                continue
            if k not in UNNAMED_KEYS:
                out.append(str(k).replace("_", " "))
            _parts(v[k], out)
    elif isinstance(v, (list, tuple)):
        for x in v:
            _parts(x, out)
    elif isinstance(v, str):
        s = v.strip()
        if s[:1] in ("{", "["):
            try:
                return _parts(json.loads(s), out)
            except ValueError:
                pass
        out.append(s)
    else:
        out.append(str(v))


def flatten_json(body: str | None) -> str:
    out: list[str] = []
    _parts(body, out)
    return " ".join(s for s in (" ".join(p.replace("_", " ").split()) for p in out) if s)


@F.pandas_udf(StringType())
def flatten_udf(body: pd.Series) -> pd.Series:
    return body.map(flatten_json)


def tool_name(body: Column) -> Column:
    """The name in a JSON object, empty where there is none."""
    return F.coalesce(F.get_json_object(body, "$.name"), F.lit(""))


@F.pandas_udf(StringType())
def normalize_udf(text: pd.Series) -> pd.Series:
    """NFKC, case folding, white space joined."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def normalize_ascii(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def ranking_fingerprint(ids: Column) -> Column:
    """SHA-256 of an array of ids as a JSON list in ASCII, with a space behind each comma.

    Ids of plain ASCII need no escapes and stay in the JVM; others are written by the JSON writer and escaped by code unit.
    """
    plain = F.concat(F.lit('["'), F.array_join(ids, '", "'), F.lit('"]'))
    plain = F.when(F.size(ids) == 0, F.lit("[]")).otherwise(plain)
    odd = F.exists(ids, lambda x: x.isNull() | x.rlike(r'[^\x20-\x7e]|["\\\\]'))
    return F.when(ids.isNotNull(), F.sha2(F.when(odd, _json_list(F.when(odd, ids))).otherwise(plain), 256))


@F.pandas_udf(StringType())
def _json_list(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: None if x is None else json.dumps([None if i is None else str(i) for i in x]))
