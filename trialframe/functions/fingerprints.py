"""Canonical JSON and content fingerprints.

Two routes give the same text.  The JVM route is taken for configs in which
both number and string printing agree by construction: printable ASCII without
escapes, and no number with a fraction, an exponent or 19 and more digits.
Everything else goes through one Arrow-batched Python function.  Rows on the
JVM route reach the Python worker only as NULLs.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: fingerprints are the first 16 hex digits of SHA-256.
FINGERPRINT_LENGTH = 16

# Fixed value: what is hashed.  The metric name is deliberately not in it.
_PAYLOAD = '{"config":%s,"objective":%s,"project":%s}'

_PLAIN_TEXT = r"^[ !#-\[\]-~]*\z"
# A character or number that the two routes might print differently.
_DELICATE = r"[^\t\n\r -\[\]-~]|[0-9][.eE]|[0-9]{19}"


def text_fingerprint(text: Column) -> Column:
    """Fingerprint of a text such as a diff (UTF-8 bytes)."""
    return F.substring(F.sha2(text, 256), 1, FINGERPRINT_LENGTH)


def _canonical_text(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):  # RecursionError: nested too deeply
        return None
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _canonical_python(raw: pd.Series) -> pd.Series:
    return raw.map(_canonical_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def _payload_python(
    config: pd.Series, objective: pd.Series, project: pd.Series
) -> pd.Series:
    def one(raw, goal, name):
        text = _canonical_text(raw)
        if text is None or goal is None or name is None:
            return None
        return _PAYLOAD % (text, json.dumps(goal), json.dumps(name))

    return pd.Series([one(*row) for row in zip(config, objective, project)])


def canonical_json_jvm(raw: Column) -> Column:
    """Canonical JSON where the JVM route is provably exact, else NULL.

    The parser ignores what follows the first value.  Its text counts only if
    it is as long as the raw text without the blanks outside strings, so that
    nothing was left out (there are no escapes on this route).
    """
    text = F.to_json(F.try_parse_json(raw))
    bare = F.regexp_replace(raw, r'("[^"]*")|[ \t\n\r]+', "$1")
    return F.when(~raw.rlike(_DELICATE) & (F.length(text) == F.length(bare)), text)


def canonical_json(raw: Column) -> Column:
    """JSON with sorted keys and no blanks; NULL for text that is not JSON."""
    jvm = canonical_json_jvm(raw)
    return F.coalesce(jvm, _canonical_python(F.when(jvm.isNull(), raw)))


def _payload_jvm(config: Column, objective: Column, project: Column) -> Column:
    plain = objective.rlike(_PLAIN_TEXT) & project.rlike(_PLAIN_TEXT)
    quoted = _PAYLOAD % ("%s", '"%s"', '"%s"')
    parts = (canonical_json_jvm(config), objective, project)
    known = parts[0].isNotNull() & plain
    return F.when(known, F.format_string(quoted, *parts))


def config_fingerprint(config: Column, objective: Column, project: Column) -> Column:
    """Fingerprint of a raw JSON config within a project and objective.

    NULL when the config is not JSON.
    """
    jvm = _payload_jvm(config, objective, project)
    rest = [F.when(jvm.isNull(), part) for part in (config, objective, project)]
    return text_fingerprint(F.coalesce(jvm, _payload_python(*rest)))


def config_fingerprint_jvm(
    config: Column, objective: Column, project: Column
) -> Column:
    """As :func:`config_fingerprint`, without Python; raises on other configs.

    For tables known to hold plain configs only.  Fingerprints of both forms
    are equal, so they may be compared.
    """
    refusal = F.raise_error(F.lit("config needs config_fingerprint()")).cast("string")
    payload = F.coalesce(_payload_jvm(config, objective, project), refusal)
    return F.when(config.isNotNull(), text_fingerprint(payload))


def has_changes(diff: Column) -> Column:
    """True when a diff holds anything but white space."""
    return diff.isNotNull() & diff.rlike(r"(?U)[^\s\x1c-\x1f]")
