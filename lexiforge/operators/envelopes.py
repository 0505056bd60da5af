"""Fields of diagnostic records that name credentials or identities: their values are masked, whatever they hold."""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names of fields, without case, spaces, dashes and underscores.
AUTHORIZATION = ["authorization", "auth"]
CREDENTIALS = [
    "apikey", "accesskey", "accesstoken", "authtoken", "refreshtoken", "sessiontoken", "idtoken", "clientsecret", "clientcredential", "clientcredentials", "secretkey",
    "secret", "token", "password", "passwd", "pwd", "cookie", "cookies", "credential", "credentials", "capability", "capabilities",
]
IDENTITIES = ["clientid", "targetid", "sessionid", "leaseid", "requestid", "cdptargetid", "cdpsessionid", "brokerid", "connectionid", "client", "target", "session", "lease", "request"]
_KIND = dict.fromkeys(AUTHORIZATION, "[redacted-authorization]") | dict.fromkeys(CREDENTIALS, "[redacted-credential]") | dict.fromkeys(IDENTITIES, "[redacted-id]")
_UUID = regex.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", regex.IGNORECASE)

_NAMES = "|".join(r"[\s_-]*".join(name) for name in sorted(_KIND, key=len, reverse=True))
#: A name, then perhaps a sign or a space and a value: the beginning of an object or list, a string with plain or escaped
#: quotes, or a bare word. What is opened and not closed reaches to the end of the text.
_FIELD = regex.compile(
    rf"""(?P<head>(?:^|[^A-Za-z0-9_])["']?(?>(?P<name>{_NAMES}))(?>(?:\\?["'])?))
    (?:(?P<sign>\s*[:=]\s*|\s+)(?:
        (?P<nest>[\[{{])
      | (?P<open>\\["']|["'])(?>(?!(?P=open))(?:\\.?|[^\\]))*+(?P<shut>(?P=open))?
      | [^\s,;\]}}]+
    ))?""",
    regex.IGNORECASE | regex.DOTALL | regex.VERBOSE,
)


def kind_of(name: str) -> str | None:
    """What stands for the value of a field of that name; None for ordinary fields."""
    return _KIND.get(regex.sub("[^A-Za-z0-9]", "", name).lower())


_TOKENS = regex.compile(r"""[\[\]{}]|(?P<quote>["'])(?>(?!(?P=quote))(?:\\.?|[^\\]))*+(?P=quote)?""", regex.DOTALL)
_CLOSES = {"[": "]", "{": "}"}


def _nest_end(text: str, start: int) -> int:
    """Where the object or list that begins at ``start`` ends; however deep, without recursion."""
    due = []
    for token in _TOKENS.finditer(text, start):
        if token[0] in _CLOSES:
            due.append(_CLOSES[token[0]])
        elif token[0] == due[-1]:
            due.pop()
            if not due:
                return token.end()
    return len(text)


def scrub(text: str) -> str:
    out, at = [], 0
    while found := _FIELD.search(text, at):
        out.append(text[at : found.start()] + found["head"])
        at = found.end()
        if found["sign"] is not None:
            out.append(f"{found['sign']}{found['open'] or ''}{kind_of(found['name'])}{found['shut'] or ''}")
            if found["nest"]:
                at = _nest_end(text, at - 1)
    return "".join(out) + text[at:]


def scrub_value(value, top: bool = True):
    """A JSON value without the values of such fields; strings are scrubbed as text. A UUID as the record's own requestId stays."""
    if isinstance(value, str):
        return scrub(value)
    if isinstance(value, list):
        return [scrub_value(x, False) for x in value]
    if not isinstance(value, dict):
        return value
    correlates = lambda k, x: top and k == "requestId" and isinstance(x, str) and _UUID.fullmatch(x)
    return {k: x if correlates(k, x) else kind_of(k) or scrub_value(x, False) for k, x in value.items()}


def _scrub_record(record: str) -> str:
    try:
        value = json.loads(record)
    except (ValueError, RecursionError):
        return scrub(record)
    return json.dumps(scrub_value(value), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def scrub_text(texts: pd.Series) -> pd.Series:
    """Texts of ``name: value``, ``name=value`` and ``name value``; null stays null."""
    return texts.map(scrub, na_action="ignore")


@F.pandas_udf(StringType())
def scrub_record(records: pd.Series) -> pd.Series:
    """JSON texts; what is not JSON is scrubbed as text. Shapes of credentials in ordinary strings are ``screening.redact``'s."""
    return records.map(_scrub_record, na_action="ignore")
