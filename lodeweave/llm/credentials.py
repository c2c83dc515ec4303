"""Credentials embedded in code, clone addresses and procedure bodies.

1. Every literal that could be a credential is extracted with its context (the name it is bound to, or
   its own structure) and indexed over the whole corpus.
2. Literals that many owners (repositories, databases) share are placeholders and are suppressed, as are
   masks, references to variables and vaults, hashes, ids and public keys.
3. Rare values are confirmed by structure (issuer prefix, signed token, key block, address with a
   password) or by the name they are bound to.
4. Every file is scanned again with an automaton of the confirmed strong values, so that a value also
   comes out where nothing around it says so.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.runtime import cut, ship

#: A value found in more owners than this, and in more than this share of all owners, is a placeholder, whatever it looks like.
MOST_OWNERS, MOST_SHARE = 12, 0.004
#: Values in one automaton; more are scanned for in several passes, so no broadcast grows with the corpus.
SHARD = 100_000
#: Where no context speaks for them, values shorter than this count only if rare, and held by the same owner or of letters and digits.
LEAST_RESCANNED = 12

# Parts of names that hold secrets, and parts after which they hold something about a secret.
_SECRET = re.compile(r"(?:^|_)(?:password|passwd|passwort|pwd|pass|passphrase|passcode|pw|secret|secrets|token|apikey|api_key|access_key|private_key|signing_key|encryption_key|auth_key|service_key|deploy_key|host_key|tls_key|ssl_key|master_key|shared_key|account_key|storage_key|secret_key|credential|credentials|cred|creds|pin|pincode|authorization|auth|bearer|connection_string|dsn)(?:$|_)")
_ABOUT = re.compile(r"(?:^|_)(?:url|uri|endpoint|ttl|seconds|minutes|hours|days|name|names|header|min|max|length|len|size|count|expiry|expires|expiration|lifetime|hash|hashes|hashed|digest|checksum|path|file|dir|type|policy|field|label|hint|rotation|env|var|algorithm|alg|prefix|suffix|issuer|audience|scope|scopes|provider|manager|service_name|id|ids|kind|mode|enabled|required|column|public|pub|fingerprint|user|username|attempts|retries|regex|pattern|format|version|source|ref|timeout|cache|limit)$|(?:^|_)public_|(?:^|_)(?:min|max)_")
_NEUTRAL_NO = re.compile(r"(?:^|_)(?:sha\d*|md5|hash|checksum|digest|etag|commit|commits|revision|rev|ref|uuid|guid|trace|span|request|integrity|fingerprint|signature|tenant|build|id|ids|public_key|public|pub|head|since|parent|sum|crc|nonce|salt|row|version|hex|color|image|sri|thumbprint|serial|correlation|session_id|object|blob|tree|oid)(?:$|_)")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:|[x*.•_?#-]{2,}|x{3,}.*|\.{3}|<.*>|\[.*\]|\$\{.*\}|\$\(.*\)|\$\w+|\{\{.*\}\}|\{[\w.:-]*\}|%[\w.-]+%|%\(?\w*\)?[sd]|@[\w.]+@|#\{.*\}|__\w+__|vault[:/].*|ref\+.*|env[:/].*|secret(?:s?manager)?[:/].*|ssm[:/].*|aws[:/].*|gcp[:/].*|keyvault[:/].*|arn:.*|op://.*|sops[:/].*|(?:process\.env|os\.environ|os\.getenv|system\.getenv|env|getenv|config|settings|secrets|vars|var|local|data|self|this|props|args|params)[.\[(].*"
    r"|change[-_ ]?(?:me|it|this)?|replace[-_ ]?(?:me|it|this|with[-_ ].*)|example(?:[-_ ]?(?:password|passwd|pass|pwd|secret|token|key|value|only))?\d*|sample|dummy|todo|tbd|fixme|not[-_ ]?set|unset|none|null|nil|undefined|n/?a|empty|default|placeholder|redacted|masked|hidden|removed|your[-_ ].*|my[-_ ](?:password|token|secret|key)|insert[-_ ].*|enter[-_ ].*|set[-_ ]by.*|ask[-_ ].*|see[-_ ].*|test|testing|foo|bar|baz|string|str|text|value|true|false|yes|no|password|passwd|secret|token|key|apikey|api[-_]key|pwd|pass|username|user|admin|root|p_?pw|required|optional|ignored)$"
)
# How credentials of known issuers look.
_STRUCTURED = re.compile(
    r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|gl(?:ptt|dt|rt|soat|ft)-[A-Za-z0-9_-]{16,}|(?:sk|rk|pk)_live_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{16,}|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|xox[abeprs]-[A-Za-z0-9-]{12,}|xapp-[A-Za-z0-9-]{12,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|AIza[A-Za-z0-9_-]{30,}|ya29\.[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{30,}|dop_v1_[a-f0-9]{40,}|hf_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|sq0[a-z]{3}-[A-Za-z0-9_-]{20,}|shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}|(?:sk|pk)-[A-Za-z0-9_-]{32,}|AccountKey=[A-Za-z0-9+/=]{40,})"
)
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ADDRESS = re.compile(r"\b([A-Za-z][A-Za-z0-9+.-]*)://([^\s/?#'\"`<>]*):([^\s/'\"`<>]+)@([A-Za-z0-9\[][\w.:\]-]*)")
_HEADER = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9+/=._~-]{6,})")
_QUOTED = r"(?:[NnrRbBuUfF]{0,2}(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|''|[^'\\])*)'|`([^`]*)`))"
_JOIN = r"(?:\s*(?:\+|\.\.|\|\||&|\\)?\s*" + _QUOTED + r")*"
_BOUND = re.compile(r"""(?<![\w.])["'`]?@?([A-Za-z_][\w.-]*(?:\[[\"'][\w.-]+[\"']\])?)["'`]?\]?\s*(?::\s*[\w<>\[\]]+\s*)?(?:=>|:=|\?\?=|=|:)\s*(""" + _QUOTED + _JOIN + ")")
_ATTRIBUTE = re.compile(r"""(?i)\b(?:name|key|id)\s*=\s*["']([\w.-]+)["']\s+value\s*=\s*(["'])(.*?)\2""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)(?:\s[^<>]*)?>([^<>]+)</\1\s*>")
_FALLBACK = re.compile(r"""(?i)(?:environ\.(?:setdefault|get)|getenv|env|getProperty|get|getOrDefault)\s*\(\s*["'`]([\w.-]+)["'`]\s*,\s*(""" + _QUOTED + _JOIN + r""")|(?:process\.env|env|ENV)(?:\.([\w]+)|\[["']([\w.-]+)["']\])\s*\)?\s*(?:\|\||\?\?|or)\s*(""" + _QUOTED + _JOIN + ")")
_DEFAULTED = re.compile(r"\$\{([\w.-]+):-?([^{}]+)\}")
_PROSE = [
    re.compile(r"(?i)\blog(?:in|\s+in)?\s+as\s+\S+\s*/\s*([\w.-]+)\s*[=:]\s*(\S+)"),
    re.compile(r"(?i)(?:^|\W)([a-z][\w.-]*(?: [a-z][\w-]*){0,4}) for the [\w -]+:\s*(\S+)"),
    re.compile(r"(?i)\b([\w.-]+) is (?:read from|set to)\s+(\S+)"),
    re.compile(r"(?i)\b(?:set|use|export)\s+[`'\"]?([\w.-]+)[`'\"]?\s+(?:to|as)\s+[`'\"]?([^\s`'\"]+)"),
    re.compile(r"(?i)\buses?\s+[`'\"]?([\w.-]+)[`'\"]?\s*[=:]\s*[`'\"]?([^\s`'\"]+)"),
    re.compile(r"(?i)\bvalues\s*\(\s*'([\w.-]+)'\s*,\s*'((?:''|[^'])*)'\s*\)"),
    re.compile(r"""(?i)\b(?:of|put|set|setProperty|entry)\(\s*"([\w.-]+)"\s*,\s*"([^"]*)"\s*\)"""),
    re.compile(r"(?i)(?:^|[\s/#*;({-])[`'\"]?([A-Za-z][\w.-]*)[`'\"]?\s*[=:]\s*[`]([^`]+)[`]"),
]
_LOGIN = re.compile(r"(?i)\b(?:seed |test |demo |default )?(?:login|account|user)s?:?\s+\S+\s*/\s*(?![\w.-]+\s*[=:]\s)(\S+)|/user:\S+\s+(\S+?)(?=['\"]|\s|$)|\bnet\s+use\b.*?\s/user:\S+\s+([^\s'\"]+)")
_SQL = re.compile(r"(?i)\b(?:identified\s+(?:with\s+\w+\s+)?by|password)\s*=?\s*N?'((?:''|[^'])*)'")
_PAIR = re.compile(r"(?i)\b(pwd|password|passwd|pass|secret|token|access_token|private_token|api_key|apikey|accountkey|sharedaccesskey)\s*=\s*([^\s;'\"&`]+)")
_PLAIN = re.compile(r"^\s*(?:export\s+|ENV\s+|ARG\s+|set\s+|-\s+|#+\s*|//+\s*|--\s*|/\*\s*|\*\s*|;\s*)*([A-Za-z_][\w.-]*)\s*[=:]\s*(?![=>])([^\s'\"`{\[(][^\s'\"`]*)\s*(?:\*/)?\s*$")
_OPENED = re.compile(r"^\s*(?:[\w.]+\s+)*([A-Za-z_][\w.]*)\s*(?::\s*\w+\s*)?(?:=|:=)\s*\(?\s*\\?\s*$")
_ONLY_QUOTED = re.compile(r"^\s*" + _QUOTED + _JOIN + r"\s*[+\\]?\s*\)?;?\s*$")
_MAYBE = re.compile(r"(?i)pass|pwd|\bpw|_pw|secret|token|key|cred|auth|\bpin(?:\b|_|[A-Z])|_pin|://|bearer|basic |login|log in|identified|private|gh[pousr]_|glpat|_live_|akia|asia|xox|eyJ|/user:|\bdsn\b|[A-Za-z0-9+/_.-]{20,}")
_OWNED = re.compile(r"(?i)\binsert\s+into\s+[\w.]+\s*\(\s*\w*(?:owner|user|login|account|member)\w*\s*,\s*\w*(?:value|secret|pass|pw|key|token|cred)\w*\s*\)\s*values\s*\(\s*'([\w.-]+)'\s*,\s*'((?:''|[^'])*)'")
_EACH = re.compile(_QUOTED)
_GOES_ON = re.compile(r"\s*(?:\+|\.\.?|\|\||&|\\)\s*$")
_CONTINUED = re.compile(r"^\s*(\+|\.\.?|\|\||&)?\s*" + _QUOTED + _JOIN + r"\s*(\+|\.\.?|\|\||&|\\)?\s*[),;]*\s*$")
# Parts of a key in a line: escapes stay, runs of its alphabet go.
_KEY_RUN = re.compile(r"(\\+(?:u[0-9A-Fa-f]{4}|[nrt])|&#?\w+;)|(?:[A-Za-z0-9+/=]|\\/)+")
_KEY_TEXT = re.compile(r"(?:[A-Za-z0-9+/=]|\\+[nrt/])*")
_KEY_HEADER = re.compile(r"^\W*[A-Z][A-Za-z-]*: ")


def name_of(raw: str) -> str:
    """Comparable name: camel case and separators to underscores, trailing numbers dropped."""
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", re.sub(r".*\[[\"']|[\"']\]", "", raw))
    s = re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()
    return re.sub(r"^x_(?=\w)", "", re.sub(r"(?:_\d+|_[a-z])+$", "", re.sub(r"(?<=[a-z])\d{2,}$", "", s)))


def joined(text: str) -> str:
    """The value of one or more adjacent string literals."""
    return "".join(next((g for g in m.groups() if g is not None), "") for m in _EACH.finditer(text))


def placeholder(value: str) -> bool:
    v = value.strip().rstrip(";,")
    return bool(_PLACEHOLDER.match(v)) or len(set(v)) <= 1 or "<" in v[:1] or bool(re.search(r"\$\{[^}]*\}|\{\{.*\}\}|%[A-Z_]{3,}%|\$\([A-Z_]+\)", v))


# What the documentation of issuers puts into values of their form.
_DOCUMENTED = re.compile(r"(?i)example|sample|placeholder|x{6,}|0{8,}|1234567890|abcdefghij|your[-_]?(?:key|token|secret)")


#: A token that nothing names as a secret is one of at most so many characters: what is longer is encoded data, not a
#: credential. Values of a secret's name, of an issuer's form or of a key block may be of any length.
LONGEST_UNNAMED = 128


def random_looking(value: str) -> bool:
    """A token without structure: long, no blanks, and of mixed kinds of characters."""
    v = value
    if re.search(r"[\s(){}<>,;:\"']|://", v) or not 20 <= len(v) <= LONGEST_UNNAMED:
        return False
    if re.fullmatch(r"[0-9a-fA-F]{8}-[0-9a-fA-F-]+", v):
        return False
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", v):
        return len(v) in (32, 40, 48, 64) and not v.isdigit()
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    longest = max(map(len, re.split(r"[_./+=-]", v)))
    return kinds == 3 and longest >= 16


def address_password(text: str) -> str | None:
    """The password of an address in the text, unless it is a placeholder."""
    for m in _ADDRESS.finditer(text):
        # the last @ before the host ends the password
        if m.group(2).startswith(("$", "{")) and not m.group(3):
            continue
        if not placeholder(m.group(3)) and len(m.group(3)) > 2:
            return m.group(3)
    return None


def judge(name: str | None, value: str, strong_context: bool = False) -> tuple[str, str] | None:
    """(kind, secret) if the value bound to a name can be a credential: 'structured' or 'named'."""
    v = value.strip()
    if not v or "ssh-rsa AAAA" in v or re.match(r"(?:ssh-(?:rsa|ed25519|dss)|ecdsa-\S+) ", v) or v.startswith(("ssh-ed25519", "ssh-rsa", "sha256-", "sha384-", "sha512-")):
        return None
    if _KEY_BLOCK.search(v):
        return "structured", key_id(v[v.index("-----BEGIN") :])
    pw = address_password(v)
    if pw:
        return "structured", pw
    if "://" in v and not strong_context:
        return None
    m = _STRUCTURED.search(v)
    if m and not _DOCUMENTED.search(m.group()):
        return "structured", m.group()
    if m or placeholder(v):
        return None
    m = _HEADER.fullmatch(v) or (_HEADER.search(v) if re.match(r"(?i)authorization|proxy-auth", v) else None)
    if m:
        return header(m)
    key = name_of(name) if name else ""
    bare = re.sub(r"_hash$", "", key)
    if key and _SECRET.search(bare) and not _ABOUT.search(key) and not re.search(r"(?:^|_)public(?:_|$)", key) or strong_context:
        if len(v) < 4 or re.search(r"\s", v.strip()) and not strong_context:
            return None
        if v.isdigit() and not (4 <= len(v) <= 12 and (re.search(r"(?:^|_)pin", key) or strong_context or re.search(r"pass|pwd|(?:^|_)pw(?:$|_)|secret", key))):
            return None
        if re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+(?:\(.*)?", v) and not re.search(r"\d", v) or re.search(r"\(.*\)?$", v) and re.match(r"[A-Za-z_.]+\(", v):
            return None  # an expression
        if "://" in v or v.startswith(("/", "./", "~/")) and "/" in v[1:]:
            return None
        return "named", v
    if key and not _NEUTRAL_NO.search(key) and not _ABOUT.search(re.sub(r"(?:^|_)endpoint$", "", key)) and random_looking(v):
        return "structured", v
    return None


def header(m: re.Match) -> tuple[str, str] | None:
    """A credential in an authorisation header: basic must decode to user:password."""
    value = m.group(2)
    if m.group(1).lower() == "basic":
        try:
            plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8", "replace")
        except (binascii.Error, ValueError):
            return None
        user, colon, pw = plain.partition(":")
        return ("structured", value) if colon and pw and not placeholder(pw) else None
    if placeholder(value) or len(value) < 8:
        return None
    return "structured", value


def key_id(text: str) -> str:
    """What stands for a key block among the values."""
    plain = re.sub(r"[^A-Za-z0-9+/=]", "", re.sub(r"-----[A-Z ]+-----", "", text))
    return f"key block {blake2b(plain.encode(), digest_size=16).hexdigest()}"


def key_text(line: str) -> str | None:
    """The key's text in a line that holds nothing else but quotes, comment signs and operators."""
    s = line.strip(" \t\r\"'`#*;|>.,&()[]{}\\+/-")
    return s if _KEY_TEXT.fullmatch(s) else None


def key_end(lines: list[tuple[int, str]], at: int, marks: list[int]) -> int:
    """Index of the last line of the key block that begins at a line; marks: lines with BEGIN or END."""
    if "-----END" in lines[at][1][list(_KEY_BLOCK.finditer(lines[at][1]))[-1].end() :]:
        return at
    k = bisect_right(marks, at)
    if k < len(marks):
        closing, opening = lines[marks[k]][1].find("-----END"), _KEY_BLOCK.search(lines[marks[k]][1])
        if closing >= 0 and (not opening or closing < opening.start()):
            return marks[k]
    last, full = at, False  # cut off: as far as the lines are a key's
    for j in range(at + 1, marks[k] if k < len(marks) else len(lines)):
        text = key_text(lines[j][1])
        if text is None and not _KEY_HEADER.match(lines[j][1]) or text and len(text) < 20 and not full:
            break
        if text:
            last, full = j, True
            if len(text) < 20:
                break
    return last


def candidates(lines: list[tuple[int, str]]) -> list[tuple[int, str, str]]:
    """(line_no, kind, value) of every literal in a text that can be a credential."""
    return list(dict.fromkeys(x[:3] for x in extents(lines)))


def extents(lines: list[tuple[int, str]]) -> list[tuple[int, str, str, tuple[tuple[int, str, str], ...]]]:
    """(line_no, kind, value, ((line_no, how, part), ...)): candidates with every line that they cover.

    how: 'value' (the part as it is), 'key' (a line of a key block) or 'literals' (the literals that the part begins with).
    """
    out: list[tuple[int, str, str, tuple[tuple[int, str, str], ...]]] = []
    waiting: str | None = None  # a name whose value begins on a later line
    marks = [i for i, (_, s) in enumerate(lines) if "-----END" in s or _KEY_BLOCK.search(s)]
    in_key = skip_to = 0

    def literals(first: int, value: str, end: int, begun: str = "") -> tuple[tuple[int, str, str], ...]:
        covers, left = [], value
        for j in range(first, end):
            covers.append((lines[j][0], "literals", left))
            left = left[len(begun if begun and j == first else joined(lines[j][1])) :]
        return tuple(covers)

    for at, (no, line) in enumerate(lines):
        if at < skip_to or at < in_key and (key_text(line) is not None or _KEY_HEADER.match(line) or "-----END" in line):
            continue
        if waiting:
            m = _ONLY_QUOTED.match(line)
            if m:
                value, k = joined(line), at + 1
                while k < len(lines) and _ONLY_QUOTED.match(lines[k][1]):
                    value += joined(lines[k][1])
                    k += 1
                got = judge(waiting, value)
                if got:
                    out.append((no, *got, literals(at, value, k)))
                waiting, skip_to = None, k
                continue
            waiting = None
        if not line or not _MAYBE.search(line) and not _OPENED.match(line):
            continue
        if _KEY_BLOCK.search(line):
            last = key_end(lines, at, marks)
            value = key_id(line[line.index("-----BEGIN") :] + "".join(s for _, s in lines[at + 1 : last + 1]))
            out.append((no, "structured", value, ((no, "value", value), *((n, "key", "") for n, _ in lines[at + 1 : last + 1]))))
            in_key = last + 1
            continue
        found = [(None, m.group()) for m in _STRUCTURED.finditer(line)] + [(None, m.group()) for m in _ADDRESS.finditer(line)]
        hits = [h for h in (judge(n, v) for n, v in found) if h]
        for m in _HEADER.finditer(line):
            if re.search(r"(?i)authorization|header|hdr|curl", line[: m.start()] + name_of(line[:40])) or m.group(1).lower() == "basic":
                hits.append(header(m))
        attributes = list(_ATTRIBUTE.finditer(line))
        for m in _BOUND.finditer(line):
            if attributes and m.group(1).lower() in ("value", "name", "key", "id"):
                continue  # judged below by the attribute's own name
            inner, k = joined(m.group(2)), at + 1
            begun, goes_on = inner, bool(_GOES_ON.match(line, m.end()))
            if goes_on or not line[m.end() :].strip():
                while k < len(lines) and (c := _CONTINUED.match(lines[k][1])) and (goes_on or c.group(1)):
                    inner += joined(lines[k][1])
                    goes_on, k = bool(c.groups()[-1]), k + 1
            got = judge(m.group(1), inner)
            if got and k > at + 1:
                out.append((no, *got, literals(at, inner, k, begun)))
                skip_to = k
            else:
                hits.append(got)
            hits += [judge(k, v) for k, v in _PAIR.findall(inner)] if "=" in inner else []
        for m in attributes:
            hits.append(judge(m.group(1), m.group(3)))
        for m in _ELEMENT.finditer(line):
            hits.append(judge(m.group(1), m.group(2)))
        for m in _FALLBACK.finditer(line):
            hits.append(judge(m.group(1) or m.group(6) or m.group(7), joined(m.group(2) or m.group(8) or "")))
        for m in _DEFAULTED.finditer(line):
            hits.append(judge(m.group(1), m.group(2)))
        for p in _PROSE:
            for m in p.finditer(line):
                hits.append(judge(m.group(1), m.group(2).strip("'\"`,;")))
        for m in _LOGIN.finditer(line):
            v = next(g for g in m.groups() if g)
            hits.append(judge("password", v.strip("'\"`,;"), strong_context=True) if "://" not in v else judge(None, v))
        m = _OWNED.search(line)
        if m and not any(p.search(name_of(m.group(1))) for p in (_SECRET, _ABOUT, _NEUTRAL_NO)) and len(m.group(2)) > 5:
            hits.append(judge("password", m.group(2)))
        for m in _SQL.finditer(line):
            hits.append(judge("password", m.group(1), strong_context="://" not in m.group(1)))
        for m in re.finditer(r"(?i)'[^']*\b(?:pwd|password|passwd)\s*=\s*([^\s;'\"&`]+)", line):
            hits.append(judge("password", m.group(1)))
        m = re.search(r"""['"]X?-?([\w-]+):\s+([^'"]+)['"]""", line)
        if m and re.search(r"(?i)curl|header", line):
            hits.append(judge(m.group(1), m.group(2)))
        m = _PLAIN.match(line)
        if m:
            hits.append(judge(m.group(1), m.group(2).rstrip(",;")))
        out += [(no, *h, ((no, "value", h[1]),)) for h in dict.fromkeys(h for h in hits if h)]
        m = _OPENED.match(line)
        if m:
            waiting = m.group(1)
    return list(dict.fromkeys(out))


def address_candidates(url: str | None) -> list[tuple[int, str, str]]:
    """Credentials in a clone address: a password, a token in place of a user, or a token parameter."""
    if not url:
        return []
    out = []
    m = re.match(r"(?i)\s*[a-z][a-z0-9+.-]*://([^/?#]*@)?", url)
    rest = url[m.end() :] if m else url
    if m and m.group(1):
        user, colon, pw = m.group(1)[:-1].partition(":")
        # a password may hold @ and even /: everything up to the last @ before the host
        if colon and pw and not placeholder(pw):
            out.append((1, "structured", pw))
        elif not colon and not placeholder(user) and (_STRUCTURED.fullmatch(user) or random_looking(user) or len(user) >= 16 and re.search(r"\d", user) and re.search(r"[A-Za-z]", user)):
            out.append((1, "structured", user))
        elif colon and not pw and (_STRUCTURED.fullmatch(user) or random_looking(user)):
            out.append((1, "structured", user))
    for k, v in re.findall(r"[?&#;]([\w.-]+)=([^&#;\s]+)", rest):
        if _SECRET.search(name_of(k)) and not _ABOUT.search(name_of(k)) and not placeholder(v) and len(v) > 3:
            out.append((1, "structured", v))
    return list(dict.fromkeys(out))


def places(files: DataFrame, repositories: DataFrame, procedures: DataFrame) -> DataFrame:
    """All places as rows (source_table, record_id, owner, lines array<struct<n, s>>)."""
    line = "array<struct<n:int,s:string>>"
    f = files.select(
        F.lit("scanned_files").alias("source_table"), F.col("file_id").cast("bigint").alias("record_id"), F.col("repo").alias("owner"),
        F.array_sort(F.transform("code_lines", lambda x: F.struct(x["line_no"].cast("int").alias("n"), x["line_text"].alias("s")))).cast(line).alias("lines"),
    )
    r = repositories.select(F.lit("repositories").alias("source_table"), F.col("repo_id").cast("bigint").alias("record_id"), F.col("repo").alias("owner"), F.array(F.struct(F.lit(1).alias("n"), F.col("url").alias("s"))).cast(line).alias("lines"))
    p = procedures.select(
        F.lit("stored_procedures").alias("source_table"), F.col("procedure_id").cast("bigint").alias("record_id"), F.col("database_name").alias("owner"),
        F.transform(F.split("definition", "\n"), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("s"))).cast(line).alias("lines"),
    )
    return f.unionByName(r).unionByName(p)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for table, rid, owner, lines in zip(b["source_table"], b["record_id"], b["owner"], b["lines"]):
            if lines is None:
                continue
            texts = [(x["n"], x["s"] or "") for x in lines if x["n"] is not None]
            if table == "repositories":
                got = [(n, kind, v, ((n, "value", v),)) for n, kind, v in address_candidates(texts[0][1] if texts else None)]
            else:
                got = dict.fromkeys(extents(texts))
            rows += [(table, rid, owner, n, kind, v, [{"n": at, "how": how, "part": part} for at, how, part in covers]) for n, kind, v, covers in got]
        yield pd.DataFrame(rows, columns=["source_table", "record_id", "owner", "line_no", "kind", "value", "covers"])


_COVERS = "array<struct<n:int,how:string,part:string>>"
_PLACE = f"source_table string, record_id bigint, owner string, line_no int, kind string, value string, covers {_COVERS}"


def find_credentials(files: DataFrame, repositories: DataFrame, procedures: DataFrame) -> DataFrame:
    """(source_table, record_id, line_no, value): one row per place and confirmed value.

    Null texts hold nothing; a line without a number is not reported. Repeated rows come out once per
    id. A value is confirmed if it is structured or bound to a secret's name, and held by at most
    ``MOST_OWNERS`` owners or ``MOST_SHARE`` of all owners; a value that more of them share is a placeholder.
    """
    return covered(files, repositories, procedures).select("source_table", "record_id", "line_no", "value").distinct()


def covered(files: DataFrame, repositories: DataFrame, procedures: DataFrame) -> DataFrame:
    """The rows of ``find_credentials`` with all lines that each value covers, as ``extents`` has them."""
    spark = files.sparkSession
    ship(spark)
    everything = places(files, repositories, procedures)
    index = cut(everything.mapInPandas(_extract, _PLACE))
    owners = index.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    most = max(MOST_OWNERS, int(MOST_SHARE * everything.select("owner").distinct().count()))
    kept = index.join(owners.where(F.col("owners") > most).select("value"), "value", "left_anti")
    confirmed = cut(kept.select("source_table", "record_id", "owner", "line_no", "value", "covers").distinct())
    strong = confirmed.where(~F.col("value").startswith("key block ")).select("value").distinct()
    strong = cut(strong.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(max(1, -(-strong.count() // SHARD))))))
    again = None
    for s in range((strong.agg(F.max("shard")).first()[0] or 0) + 1):
        hits = _rescan(everything, strong.where(F.col("shard") == s))
        again = hits if again is None else again.unionByName(hits)
    again = _likely(cut(again), confirmed.select("value", "owner").distinct(), most)
    again = again.withColumn("covers", F.array(F.struct(F.col("line_no").alias("n"), F.lit("value").alias("how"), F.col("value").alias("part"))).cast(_COVERS))
    return confirmed.drop("owner").unionByName(again.drop("owner"))


def _likely(hits: DataFrame, held: DataFrame, most: int) -> DataFrame:
    """Hits of long values, and of short ones where they are no word or number that stands there by chance.

    A short value must be a token in at most ``most`` owners, and its owner must hold it as a
    credential too (``held``) or it must mix letters and digits.
    """
    short = hits.where(F.length("value") < LEAST_RESCANNED)
    rare = short.select("value", "owner").distinct().groupBy("value").agg(F.count("*").alias("owners")).where(F.col("owners") <= most).select("value")
    mixed = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    short = short.join(rare, "value", "left_semi").join(held.withColumn("is_held", F.lit(True)), ["value", "owner"], "left").where(F.col("is_held") | mixed)
    return hits.where(F.length("value") >= LEAST_RESCANNED).unionByName(short.drop("is_held"))


def _rescan(everything: DataFrame, values: DataFrame) -> DataFrame:
    """Places of the given values (at most about ``SHARD``) anywhere in the lines, whole tokens only."""
    listed = [r["value"] for r in values.select("value").collect()]
    shared = values.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        a = ahocorasick.Automaton()
        for v in shared.value:
            a.add_word(v, v)
        if shared.value:
            a.make_automaton()
        for b in batches:
            rows = []
            for table, rid, owner, lines in zip(b["source_table"], b["record_id"], b["owner"], b["lines"]):
                if lines is None or not shared.value:
                    continue
                for x in lines:
                    s = x["s"]
                    if s and x["n"] is not None:
                        for end, v in a.iter(s):
                            start = end - len(v) + 1
                            if not (start and _in_token(s[start - 1])) and not (end + 1 < len(s) and _in_token(s[end + 1])):
                                rows.append((table, rid, owner, x["n"], v))
            yield pd.DataFrame(rows, columns=["source_table", "record_id", "owner", "line_no", "value"])

    return everything.mapInPandas(run, "source_table string, record_id bigint, owner string, line_no int, value string")


def _in_token(c: str) -> bool:
    return c.isalnum() or c in "_-"


def mask(line: str, value: str) -> str:
    """The line with the value masked; quotes, separators and the rest stay, so it remains valid.

    A literal split in parts is masked part by part. A value that is not in the line leaves it as it is.
    """
    if value.startswith("key block "):
        return mask_key_begin(line)
    return line.replace(value, "REDACTED") if value in line else mask_literals(line, value)


def mask_literals(line: str, value: str) -> str:
    """The line with the literals masked that the value begins with, one after the other, from where they cover most of it."""
    spans = [m.span(k) for m in _EACH.finditer(line) if (k := next((k for k in (1, 2, 3) if m.group(k)), None))]
    best, most = [], 0
    for i, (a, b) in enumerate(spans):
        if value.startswith(line[a:b]):
            got, left = [], value
            for a, b in spans[i:]:
                if left.startswith(line[a:b]):
                    got.append((a, b))
                    left = left[b - a :]
            if len(value) - len(left) > most:
                best, most = got, len(value) - len(left)
    for a, b in reversed(best):
        line = f"{line[:a]}REDACTED{line[b:]}"
    return line


def _mask_runs(text: str, least: int = 1) -> str:
    return _KEY_RUN.sub(lambda m: m.group() if m.group(1) or len(m.group()) < least or not any(map(str.isalnum, m.group())) else "REDACTED", text)


def mask_key_begin(line: str) -> str:
    """A line with BEGIN of key blocks: all up to END on the same line, else to the end of the literal or line."""
    out, done = [], 0
    for m in _KEY_BLOCK.finditer(line):
        end = line.find("-----END", m.end())
        if end < 0:
            end = m.end() + len(re.match(r"[^\"'`<]*", line[m.end() :]).group())
        out += [line[done : m.end()], _mask_runs(line[m.end() : end])]
        done = end
    return "".join(out) + line[done:]


def mask_key(line: str) -> str:
    """A later line of a key block: the key's text before END, comment signs and code around its literals stay."""
    end = line.find("-----END")
    head, tail = (line, "") if end < 0 else (line[:end], line[end:])
    if _EACH.search(head):
        head = _EACH.sub(lambda m: _mask_runs(m.group()) if key_text(m.group()) is not None else m.group(), head)
        return _mask_runs(head, 20) + tail
    sign = re.match(r"\s*(?:#+|//+|--+|\*+|;+)?\s*", head).end()
    return head[:sign] + _mask_runs(head[sign:], 1 if key_text(head) is not None else 20) + tail


def masked(line: str | None, covers: list) -> str | None:
    """The line without the parts (how, part) that values cover in it."""
    if line is None:
        return None
    for how, part in sorted(covers, key=lambda c: (["literals", "key", "value"].index(c[0]), -len(c[1]))):
        line = mask_literals(line, part) if how == "literals" else mask_key(line) if how == "key" else mask(line, part)
    return line


def masked_lines(files: DataFrame, repositories: DataFrame, procedures: DataFrame) -> DataFrame:
    """(source_table, record_id, line_no, masked_line) for every line that a credential covers."""
    parts = covered(files, repositories, procedures).select("source_table", "record_id", F.inline("covers")).withColumnRenamed("n", "line_no")
    found = parts.groupBy("source_table", "record_id", "line_no").agg(F.sort_array(F.collect_set(F.struct("how", "part"))).alias("covers"))
    every = places(files, repositories, procedures).select("source_table", "record_id", F.inline("lines")).withColumnsRenamed({"n": "line_no", "s": "line_text"})

    @F.pandas_udf("string")
    def apply(line: pd.Series, covers: pd.Series) -> pd.Series:
        return pd.Series([masked(s, [(c["how"], c["part"]) for c in cs]) for s, cs in zip(line, covers)], dtype=object)

    return every.join(found, ["source_table", "record_id", "line_no"]).select("source_table", "record_id", "line_no", apply("line_text", "covers").alias("masked_line"))
