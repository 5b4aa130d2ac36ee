"""Personal data by weak supervision.

Patterns propose spans: those of the base kinds and looser ones. Labelers vote on every
proposed span: format checks, gazetteers, the words around it, and its borders. The votes
of the whole corpus are summed per pattern of votes, expectation-maximisation estimates
each labeler's reliability and each pattern's posterior, and a logistic classifier over
kind, votes and length is trained on these. Proposed spans that the classifier accepts
are added to the base spans, which all stay; a span of broken format teaches but is
never added.

Texts are read once, in a map without a shuffle; the driver gets the counts per pattern,
of which there are at most a few thousand whatever the corpus.

Cases: null text is empty and has no spans; repeated rows keep a row each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pin

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds.
ADDED = ("id_number", "local_phone", "iban", "spelled_email")
# The patterns of the base kinds. The runs that they start with are taken
# whole, so that a long run is passed over once.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP_RUN = re.compile(r"([0-9]++)(?:\.([0-9]+)\.([0-9]+)\.([0-9]+))?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ID_NUMBER = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])")
SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]{1,63})+"
)
# Word lists of this module: gazetteers and words of context.
DOMAIN_ENDS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at be us ca au jp br mx".split())
CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38", "22", "23", "24", "25", "26", "27")
IBAN_LANDS = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split())
CUES = {
    "email": frozenset("mail email e-mail contact write correo courriel kontakt".split()),
    "ip": frozenset("ip address host server client adresse dirección".split()),
    "card": frozenset("card visa mastercard credit debit pay karte carte tarjeta".split()),
    "phone": frozenset("phone tel call mobile fax telefon téléphone teléfono contact".split()),
    "id_number": frozenset("ssn social security".split()),
    "iban": frozenset("iban account bank konto compte cuenta".split()),
}
CUES |= {"local_phone": CUES["phone"], "spelled_email": CUES["email"]}
AGAINST = frozenset("version release isbn issn order invoice sku build chapter section page figure example".split())
LABELERS = 5
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> list[tuple[int, str, int, bool]]:
    """(start, kind, end, base) of every proposed span."""
    out = []
    if "@" in text:
        out += [(m.start(), "email", m.end(), True) for m in EMAIL.finditer(text) if m[1]]
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append((m.start(), "phone", m.end(), 9 <= len(only_digits(m[0])) <= 15))
    for m in IP_RUN.finditer(text):
        if m[2]:
            out.append((m.start(), "ip", m.end(), all(map(in_byte, m.groups()))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = only_digits(m[0])
            if 12 <= len(digits) <= 19:
                out.append((m.start(), "card", m.end(), luhn(digits)))
    if "-" in text:
        out += [(m.start(), "id_number", m.end(), False) for m in ID_NUMBER.finditer(text)]
    out += [(m.start(), "local_phone", m.end(), False) for m in LOCAL_PHONE.finditer(text)]
    out += [(m.start(), "iban", m.end(), False) for m in IBAN.finditer(text)]
    if "[" in text or "(" in text:
        out += [(m.start(), "spelled_email", m.end(), False) for m in SPELLED.finditer(text)]
    return out


def by_format(kind: str, value: str) -> int:
    digits = only_digits(value)
    if kind in ("email", "spelled_email"):
        return 1 if len(value) <= 100 and ".." not in value and value[0] not in ".-" else -1
    if kind == "ip":
        return 1 if all(in_byte(p) and (p == "0" or p[0] != "0") for p in value.split(".")) else -1
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind == "iban":
        moved = value[4:] + value[:4]
        return 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
    if kind == "id_number":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "local_phone":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    return 1 if 9 <= len(digits) <= 15 and value.count("(") == value.count(")") else -1


def by_gazetteer(kind: str, value: str) -> int:
    if kind in ("email", "spelled_email"):
        return 1 if re.split(r"[^A-Za-z0-9-]+", value)[-1].lower() in DOMAIN_ENDS else -1
    if kind == "card":
        return 1 if only_digits(value).startswith(CARD_STARTS) else -1
    if kind == "ip":
        return -1 if value.startswith(("0.", "127.", "255.")) else 1
    if kind == "iban":
        return 1 if value[:2] in IBAN_LANDS else -1
    if kind == "phone":
        return -1 if value[1] == "0" else 1
    return 0


def votes(text: str, start: int, kind: str, end: int) -> str:
    """One letter for each labeler: p for, n against, 0 for none."""
    value = text[start:end]
    around = {w.strip(".,;:()") for w in (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower().split()}
    before, after = text[start - 1 : start], text[end : end + 1]
    loose = (not before or not before.isalnum()) and (not after or not after.isalnum())
    given = (
        by_format(kind, value),
        by_gazetteer(kind, value),
        int(not CUES[kind].isdisjoint(around)),
        -int(not AGAINST.isdisjoint(around)),
        1 if loose and before not in list("/=_#") and after not in list("/=_#") else -1,
    )
    return "".join("n0p"[v + 1] for v in given)


SPANS = "array<struct<start:int,kind:string,end:int,base:boolean,votes:string,size:int>>"


def find(batches):
    """A map over Arrow batches of (doc_id, text): the proposed spans with their votes."""
    kind = pa.list_(
        pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("size", pa.int32())])
    )
    for batch in batches:
        rows = []
        for text in batch["text"]:
            text = text.as_py() or ""
            rows.append(
                [
                    {"start": s, "kind": k, "end": e, "base": b, "votes": votes(text, s, k, e), "size": min(7, (e - s) // 4)}
                    for s, k, e, b in proposals(text)
                ]
            )
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "found": pa.array(rows, kind)})


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 200):
    """Expectation-maximisation over patterns of votes with counts.

    Returns for each labeler the chances of its votes (n, 0, p) given the class, the prior,
    and the posterior of each pattern.
    """
    x = np.array([["n0p".index(c) for c in p] for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    mean = (x - 1).mean(1)
    post = 1 / (1 + np.exp(-4 * mean))
    for _ in range(rounds):
        prior = float(np.clip((weight * post).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        chance = np.ones((2, x.shape[1], 3))
        for labeler in range(x.shape[1]):
            for vote in range(3):
                is_vote = x[:, labeler] == vote
                chance[1, labeler, vote] += (weight * post * is_vote).sum()
                chance[0, labeler, vote] += (weight * (1 - post) * is_vote).sum()
        chance /= chance.sum(2, keepdims=True)
        log = [np.log(chance[c])[np.arange(x.shape[1]), x].sum(1) for c in (0, 1)]
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -50, 50)))
        if np.abs(after - post).max() < 1e-9:
            break
        post = after
    return chance, prior, post


def design(kind: str, given: str, size: int) -> list[float]:
    names = KINDS + ADDED
    one = [float(kind == k) for k in names]
    return [*one, *[float(v == s) for v in given for s in "np"], *[float(size == s) for s in range(8)], 1.0]


def classifier(rows: list[tuple[str, str, int, int]]) -> dict[tuple[str, str, int], float]:
    """Chance of personal data for each (kind, votes, size) of `rows` (with counts)."""
    if not rows:
        return {}
    counts: dict[str, int] = {}
    for _, given, _, n in rows:
        counts[given] = counts.get(given, 0) + n
    patterns = sorted(counts.items())
    _, _, post = reliabilities(patterns)
    soft = {p: float(q) for (p, _), q in zip(patterns, post, strict=True)}
    x = np.array([design(k, v, s) for k, v, s, _ in rows])
    y = np.array([soft[v] for _, v, _, _ in rows])
    weight = np.array([n for *_, n in rows], float)
    weight /= weight.mean()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - 0.05 * w
        )
        w += step
        if np.abs(step).max() < 1e-7:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {(k, v, s): float(q) for (k, v, s, _), q in zip(rows, p, strict=True)}


def detect(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id and spans (start, kind, end, base, score) of each row of `docs` (doc_id, text)."""
    found = pin(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            find, f"doc_id long, found {SPANS}"
        )
    )
    counts = (
        found.select(F.explode("found").alias("s"))
        .groupBy("s.kind", "s.votes", "s.size")
        .agg(F.count("*").alias("n"))
        .orderBy("kind", "votes", "size")
        .collect()
    )
    chance = classifier([tuple(r) for r in counts])
    out = pa.list_(
        pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])
    )

    def decide(batches):
        for batch in batches:
            rows = []
            for spans in batch["found"].to_pylist():
                scored = [s | {"score": chance[s["kind"], s["votes"], s["size"]]} for s in spans]
                base = sorted((s["start"], s["end"]) for s in scored if s["base"])
                for s in scored:
                    s["keep"] = s["base"] or (
                        s["score"] >= least
                        and s["votes"][0] == "p"
                        and not any(a < s["end"] and s["start"] < b for a, b in base)
                    )
                kept = sorted((s for s in scored if s["keep"]), key=lambda s: (s["start"], (KINDS + ADDED).index(s["kind"])))
                rows.append([{k: s[k] for k in ("start", "kind", "end", "base", "score")} for s in kept])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "spans": pa.array(rows, out)})

    return found.mapInArrow(
        decide, "doc_id long, spans array<struct<start:int,kind:string,end:int,base:boolean,score:double>>"
    )


def digest(batches):
    """A map over `detect`'s rows: the contract's columns."""
    for batch in batches:
        rows: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_added": []}
        for spans in batch["spans"].to_pylist():
            base = [s for s in spans if s["base"]]
            for k in KINDS:
                rows[f"n_{k}"].append(sum(s["kind"] == k for s in base))
            named = lambda some: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in some)
            rows["base_sha256"].append(hashlib.sha256(named(base).encode()).hexdigest())
            rows["spans"].append(named(spans))
            rows["n_added"].append(len(spans) - len(base))
        types = {k: pa.string() if k in ("base_sha256", "spans") else pa.int64() for k in rows}
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"]} | {k: pa.array(v, types[k]) for k, v in rows.items()})


def query(spark, sf_dir):
    schema = ", ".join(f"n_{k} long" for k in KINDS)
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(
        digest, f"doc_id long, {schema}, base_sha256 string, spans string, n_added long"
    )
