"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns; their values are hashed, and for each hash the distinct
owners and repositories that hold it are counted over the whole corpus. A value that many
owners hold is a copied example; one that a single owner holds looks live. Beside the base
kinds there are values after other telling names and bearer words (`named`), passwords in
addresses of connections (`login`), bodies of private keys (`pem`) and mixed-case keys
without anything telling in front (`key`). These become spans only where they look live
and touch no base span and no added one of a kind before theirs.

Nothing but built-in expressions. Matches are marked by a replacement and their places
read off the pieces between the marks. Distinct owners are counted in two groupings, so a
value that fills a third of all rows is combined before it is shuffled; its rows meet the
copied values, and no others, by value and one of `SALTS` numbers, so that they are spread.

Cases: null text is empty and has no spans; repeated rows keep a row each; a null owner
or repository counts as one of its own; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, pin

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"()(AKIA[A-Z0-9]+)"
HEX = r"()([0-9a-f]+)"
# The builder's own patterns of the added kinds.
NAMED = (
    r"""((?i:pwd|pass(?:phrase|code)|credentials?|(?:private|access|signing)_key)["']?\x20{0,8}[:=]\x20{0,8}["']?"""
    r"""|(?i:bearer)\x20{1,8})([A-Za-z0-9+/_.=~-]+)"""
)
LOGIN = r"""()((?<=://[^\s/:@"'<>]{1,64}:)[^\s/:@"'<>]{1,256}(?=@))"""
PEM = r"()((?<=-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----)[A-Za-z0-9+/=\s]+(?=-----END))"
KEY = (
    r"()((?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])"
    r"(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,})"
)
#: kind, pattern, a test without groups that every kept match passes, least length of the value.
KINDS = (
    ("assign", ASSIGN, r"(?i:word|passwd|secret|token|key)[\"' ]*[:=]", 8),
    ("access", ACCESS, r"AKIA[A-Z0-9]{12}", 16),
    ("hex", HEX, r"[0-9a-f]{32}", 32),
    ("named", NAMED, r"(?i:pwd|passphrase|passcode|credential|_key|bearer)", 8),
    ("login", LOGIN, r"://[^\s/:@]{1,64}:", 4),
    ("pem", PEM, r"PRIVATE KEY-----", 64),
    ("key", KEY, r"[A-Za-z0-9+/_-]{24}", 24),
)
BASE = ("assign", "access", "hex")
#: Owners from which on a value counts as a copied example; with this many repositories
#: two owners do. A single owner's value is never one.
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 3
#: Tasks over which the rows of one copied value are spread.
SALTS = 16
OPEN, MID, SHUT, SPARE = "\ue000", "\ue001", "\ue002", "\ue003"
SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _spans(text, kind: int, pattern: str, test: str, least: int):
    """Array of the kept matches of one kind in `text`."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$1{MID}$2{SHUT}"))
    parts = F.split(marked, OPEN, -1)

    def step(acc, part):
        head, end = F.instr(part, MID), F.instr(part, SHUT)
        span = F.struct(
            acc["at"].cast("int").alias("start"),
            F.lit(kind).alias("kind"),
            (acc["at"] + end - 2).cast("int").alias("end"),
            F.substr(part, head + 1, end - head - 1).alias("value"),
        )
        return F.struct(
            (acc["at"] + F.char_length(part) - 2).alias("at"),
            F.when(end - head - 1 >= least, F.concat(acc["spans"], F.array(span)))
            .otherwise(acc["spans"])
            .alias("spans"),
        )

    start = F.struct(
        F.char_length(F.element_at(parts, 1)).alias("at"),
        F.array().cast(f"array<{SPAN}>").alias("spans"),
    )
    found = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step)["spans"]
    return F.when(F.regexp_like(text, F.lit(test)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """uid, doc_id, owner, repository, text_hash, found: all candidate spans of each row.

    A repository is named by its owner and its own name together.
    """
    clean = F.translate(F.coalesce(F.col("text"), F.lit("")), OPEN + MID + SHUT, SPARE * 3)
    text = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner"),
        F.coalesce(F.concat(F.lit("="), F.col(repository).cast("string")), F.lit("")).alias("repository"),
        F.xxhash64("text").alias("text_hash"),
        clean.alias("_text"),
    )
    found = F.concat(
        *[_spans(F.col("_text"), i, p, t, n) for i, (_, p, t, n) in enumerate(KINDS)]
    )
    return pin(
        text.select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            "owner",
            "repository",
            "text_hash",
            found.alias("found"),
        )
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories, copied) of each candidate value."""
    held = found.select(
        "owner",
        "repository",
        F.explode(F.array_distinct(F.transform("found", lambda s: F.sha2(s["value"], 256)))).alias("value_hash"),
    ).distinct()
    per_owner = held.groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return (
        per_owner.groupBy("value_hash")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
        .withColumn(
            "copied",
            (F.col("owners") >= COPIED_OWNERS)
            | ((F.col("owners") >= 2) & (F.col("repositories") >= COPIED_REPOSITORIES)),
        )
    )


def scan(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """doc_id, text_hash and spans (start, kind, end, live) of each row, base and added.

    Base spans all stay; `live` tells the owner-specific from the copied ones.
    """
    found = candidates(docs, owner, repository)
    empty = "array<struct<start:int,kind:int,end:int,live:boolean>>"
    copied = ownership(found).where("copied").select(
        "value_hash", "copied", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    single = (
        found.select("uid", "doc_id", "text_hash", F.explode("found").alias("s"))
        .withColumn("value_hash", F.sha2("s.value", 256))
        .withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
        .join(copied, ["value_hash", "salt"], "left")
        .groupBy("uid", "doc_id", "text_hash")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("s.start", "s.kind", "s.end", F.col("copied").isNull().alias("live"))
                )
            ).alias("all")
        )
    )
    base = F.filter("all", lambda s: s["kind"] < len(BASE))

    def first(s):
        """No base span and no live one of an earlier kind touches s."""
        return ~F.exists(
            "all",
            lambda b: (b["kind"] < s["kind"])
            & (b["live"] | (b["kind"] < len(BASE)))
            & (b["start"] < s["end"])
            & (s["start"] < b["end"]),
        )

    added = F.filter("all", lambda s: (s["kind"] >= len(BASE)) & s["live"] & first(s))
    return single.select("doc_id", "text_hash", F.array_sort(F.concat(base, added)).alias("spans")).union(
        found.where(F.size("found") == 0).select(
            "doc_id", "text_hash", F.array().cast(empty).alias("spans")
        )
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "lang", put: str = "[secret]") -> DataFrame:
    """`docs` with live-looking spans replaced in `text` and `n_chars` brought up to date.

    Rows meet their spans by id and text, so null and repeated ids are replaced too.
    """
    held = free_name("held", docs.columns)
    spans = (
        scan(docs, owner, repository)
        .select("doc_id", "text_hash", F.filter("spans", lambda s: s["live"]).alias("spans"))
        .where(F.size("spans") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
        .select(F.struct("doc_id", "text_hash", "spans").alias(held))
    )

    def cut(acc, s):
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(put))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, piece).otherwise(acc["out"]).alias("out"),
        )

    own = F.col(held)
    whole = F.aggregate(own["spans"], F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut)
    text = F.concat(whole["out"], F.substr(F.col("text"), whole["at"] + 1, F.char_length("text")))
    same = F.col("doc_id").eqNullSafe(own["doc_id"]) & (F.xxhash64("text") == own["text_hash"])
    fresh = free_name("fresh", docs.columns)
    changed = docs.join(spans, same, "left").withColumn(fresh, F.when(own.isNotNull(), text).otherwise(F.col("text")))
    return changed.select(
        *[
            F.col(fresh).alias("text") if c == "text"
            else F.when(own.isNotNull(), F.char_length(fresh).cast("long")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of `scan`'s rows."""
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])

    def joined(spans):
        return F.array_join(
            F.transform(
                spans,
                lambda s: F.concat_ws(
                    ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
                ),
            ),
            ",",
        )

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))

    def count(i):
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{BASE[i]}")

    return scanned.select(
        "doc_id",
        *[count(i) for i in range(len(BASE))],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def query(spark, sf_dir):
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
