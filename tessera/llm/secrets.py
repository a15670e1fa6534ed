"""Secret scans: candidates by form, and a random forest that drops the false ones.

Candidates are runs of token characters of any length: long ones that hold digits, shorter
ones with a digit that are assigned to a name, and, with or without digits, those that
begin as an issuer's keys do or follow a word that names secrets.  The forest sees a candidate's length, transitions between
characters, how much of it words cover, signs of a path, and the words around it; it
learns from labelled findings, by default from made-up ones (labelled_findings).
"""

import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import attach
from . import kernel
from .forest import grow, predict

#: Words that name secrets, and words that name harmless tokens.
SECRET_WORDS = "token secret password passwd pwd apikey api_key key auth bearer credential credentials access private client_secret signature".split()
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum hash uuid guid id revision version card number isbn build example sample placeholder dummy test path file url page".split()
#: Common parts of identifiers and file names.
DICTIONARY = "the and for with from that this user name data file page index image test example sample value type list item order product config model view main base default service client server request response error result number string array object table column query report license version release update delete create search filter value total count start end first last new old public static final class method return import export document text content body header footer title link style script color width height background section article category archive download upload account profile setting message comment photo video audio".split()
#: How some issuers begin their keys.
ISSUED = re.compile(r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|eyJ|npm_|pypi-|SG\.)")
_ISSUED = re.compile(ISSUED.pattern[1:].encode())
#: Bytes of text before and after a candidate that are looked at.
AROUND = 48
LONG, SHORT = 16, 8

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")
_NAMED = re.compile(rb"(?i)(?:%s)[a-z_0-9]*[\s\"'=:]+$" % "|".join(SECRET_WORDS).encode())


def _token_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in string.ascii_letters + string.digits + "+/_-."]] = True
    return table


_TOKEN, _DIGIT = _token_bytes(), np.array([48 <= i <= 57 for i in range(256)])


_KIND = np.full(256, 3)
_KIND[[ord(c) for c in string.ascii_lowercase]], _KIND[[ord(c) for c in string.ascii_uppercase]], _KIND[[ord(c) for c in string.digits]] = 0, 1, 2
_VOWEL = np.zeros(256, bool)
_VOWEL[[ord(c) for c in "aeiouAEIOU"]] = True
_LONGEST_FIRST = sorted((w for w in DICTIONARY if len(w) >= 4), key=len, reverse=True)


def _covered(value: str, letters: int) -> float:
    """Share of the letters that dictionary words cover, longest first."""
    low, hit = value.lower(), 0
    for w in _LONGEST_FIRST:
        if w in low:
            hit += len(w) * low.count(w)
            low = low.replace(w, " ")
    return hit / max(letters, 1)


def features(value: str, before: str, after: str) -> list[float]:
    """A candidate's features, of all its characters and of what stands around it."""
    data = np.frombuffer(value.encode(), np.uint8)
    n = len(data)
    kinds = _KIND[data]
    lower, upper, digits, others = (int(x) for x in np.bincount(kinds, minlength=4))
    turns = int((kinds[1:] != kinds[:-1]).sum()) / max(n - 1, 1)
    counts = np.bincount(data)
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    letter, vowel = kinds < 2, _VOWEL[data]
    pair = letter[1:] & letter[:-1]  # a consonant and a vowel by turns, as language has them
    flow = int((pair & (vowel[1:] != vowel[:-1])).sum()) / max(int(pair.sum()), 1)
    runs = np.diff(np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1], [True]])))
    words = [w.lower() for w in _WORD.findall(before)[-3:]]
    tail = before.rstrip(" \t\"'")
    hexish = all(c in string.hexdigits for c in value)
    return [
        n, turns, entropy, entropy / max(math.log2(n), 1), len(share) / n,
        digits / n, upper / n, lower / n, others / n,
        _covered(value, lower + upper), flow, float(hexish), float(digits == n), float(n in (32, 40, 64)),
        float("/" in value), float(value.count(".")), float(value.count("-")), float(bool(re.search(r"(://|www\.|/)\S*$", before))), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(any(s in w for w in words for s in SECRET_WORDS)), float(any(w in HARMLESS_WORDS for w in words)), float(tail.endswith(("=", ":"))), float(before.endswith(('"', "'"))), float(after.startswith(('"', "'"))), float(bool(ISSUED.match(value))),
        int(runs.max()) / n, float(bool(re.search(r"(.)\1{4}|x{4}|example|sample|dummy|your|test|changeme", value.lower()))),
    ]


def candidates(data: bytes):
    """(start, end) bytes of candidates in a text."""
    buf = np.frombuffer(data, np.uint8)
    words = kernel.Words(buf, np.array([0, len(buf)]), _TOKEN)
    digits = np.append(0, np.cumsum(_DIGIT[buf]))
    held, size = digits[words.end] - digits[words.start], words.end - words.start
    for i in np.flatnonzero(size >= SHORT).tolist():
        s, e = int(words.start[i]), int(words.end[i])
        while e > s and data[e - 1 : e] in (b".", b"/"):
            e -= 1
        long = e - s >= LONG and held[i] >= 2
        if long or e - s >= SHORT and (_ISSUED.match(data, s) or _NAMED.search(data[max(0, s - AROUND) : s]) or held[i] and re.search(rb"[=:]\s*[\"']?$", data[max(0, s - 4) : s])):
            yield s, e


def labelled_findings(n: int = 3000, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """Made-up findings (value, before, after, is_secret): keys as issuers make them in the places
    where they leak, and what looks like them: digests, ids, numbers, paths, placeholders, embedded
    data, and words that follow a word that names secrets."""
    rng = random.Random(seed)
    chars = lambda pool, k: "".join(rng.choice(pool) for _ in range(k))
    hexa, alnum = string.digits + "abcdef", string.ascii_letters + string.digits
    base64 = alnum + "+/"
    syllables = lambda k: "".join(rng.choice("bcdfghjklmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t"]) for _ in range(k))
    words = lambda k, sep: sep.join(rng.choice(DICTIONARY) for _ in range(k))
    prose = lambda: " ".join(chars(string.ascii_lowercase, rng.randint(2, 9)) for _ in range(rng.randint(0, 4))) + " "
    out = []
    for _ in range(n):
        quote = rng.choice(['"', "'", ""])
        if rng.random() < 0.5:
            name = rng.choice(SECRET_WORDS)
            name = rng.choice([name, name.upper(), f"my_{name}", f"{rng.choice(DICTIONARY)}_{name}"])
            value = rng.choice([lambda: chars(hexa, rng.choice([32, 40, 40, 64])), lambda: chars(hexa.upper(), 40), lambda: chars(alnum, rng.randint(16, 48)), lambda: "AKIA" + chars(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + chars(alnum, 36), lambda: chars(alnum + "+/", 40), lambda: "sk_live_" + chars(alnum, 24), lambda: "eyJ" + ".".join(chars(alnum + "-_", k) for k in (rng.randint(17, 60), rng.randint(40, 1100), rng.choice([43, 86, 342]))), lambda: chars(base64, rng.randint(100, 1600)), lambda: chars(string.ascii_letters, rng.randint(12, 24))])()
            bare = ISSUED.match(value) and rng.random() < 0.6  # an issuer's key needs no name
            before = prose() + (rng.choice(["", "see ", f"{rng.choice(DICTIONARY)} ", f"{rng.choice(DICTIONARY)}: "]) if bare else rng.choice([f"{name} = ", f"{name}=", f"{name}: ", f"{name} "])) + quote
            out.append((value, before[-AROUND:], quote + rng.choice([" ", "\n", ""]), 1))
        else:
            harmless = rng.choice(HARMLESS_WORDS)
            kind = rng.randrange(13)
            value = [
                lambda: chars(hexa, rng.choice([32, 40, 64])), lambda: "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: chars(string.digits, rng.randint(12, 24)), lambda: "/".join([words(1, ""), words(1, ""), words(2, "_") + chars(string.digits, 3) + ".html"]),
                lambda: words(3, "_") + chars(string.digits, 2), lambda: rng.choice(["xxxxxxxx", "your_api_key_", "example_token_", "changeme"]) + chars("0123", rng.randint(4, 12)), lambda: words(2, "-") + "-" + chars(string.digits, 8), lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)) + "." + chars(string.digits, 3), lambda: chars(string.digits, 4) * 4,
                lambda: chars(base64, rng.randint(100, 1600)), lambda: "/".join(words(rng.randint(1, 3), rng.choice("-_")) for _ in range(rng.randint(4, 60))) + "/" + chars(string.digits, 4), lambda: syllables(rng.randint(4, 6)), lambda: rng.choice([words(2, rng.choice(["", "-", "_", "."])), words(2, "/"), words(3, "_")]),
            ][kind]()
            name = rng.choice(SECRET_WORDS) if kind in (5, 11, 12) else harmless
            harmless_data = rng.choice(["data:image/png;base64,", "data:font/woff2;base64,", "src ", "content: "])
            before = prose() + harmless_data if kind == 9 else prose() if kind in (2, 3, 7, 8, 10) and rng.random() < 0.7 else prose() + rng.choice([f"{name} ", f"{name}: ", f"{name}=", f"{name} = "]) + quote
            out.append((value, before[-AROUND:], quote + rng.choice([" ", "\n", ""]), 0))
    return out


def train(findings: list[tuple[str, str, str, int]]) -> list:
    x = np.array([features(v, b, a) for v, b, a, _ in findings], float)
    return grow(x, np.array([y for *_, y in findings], float))


def scan(docs: DataFrame, forest: list, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, start, length, kind, digest, score, is_secret): every candidate with its place in code
    points, the SHA-256 of its text (never the text), and the forest's judgement.

    Null and empty texts have no candidates; texts and candidates may be of any length; a candidate
    that is repeated is found at each place; repeated rows are scanned each, also those
    without an id; an empty table gives an empty result; other columns, whatever their
    names, are not read."""
    attach(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            ids, rows, x = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = text.encode() if text else b""
                found = list(candidates(data))
                # Places in code points, without decoding the text up to each.
                at = np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)) if found else None
                for s, e in found:
                    value = data[s:e].decode()
                    before, after = data[max(0, s - AROUND) : s].decode(errors="ignore"), data[e : e + AROUND].decode(errors="ignore")
                    issued = ISSUED.match(value)
                    kind = issued[1] if issued else "hex" if all(c in string.hexdigits for c in value) else "token"
                    ids.append(i)
                    rows.append((int(at[s]), e - s, kind, hashlib.sha256(data[s:e]).hexdigest()))
                    x.append(features(value, before, after))
            score = np.round(predict(sent.value, np.array(x, float)), 9) if x else np.zeros(0)
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(score), pa.array(score >= least)], ["id", "start", "length", "kind", "digest", "score", "is_secret"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, kind string, digest string, score double, is_secret boolean"
    return docs.select(id_col, text_col).mapInArrow(kernel.tidy(run), schema).withColumnRenamed("id", id_col)
