"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from patterns. Three labelers vote on each: a format check, a gazetteer (a table in which a part of the
span must stand, or must not) and the words before the span.
Expectation-maximisation over the counts of vote patterns estimates, for each kind, how often spans are personal data and
how reliable each labeler is; its posteriors are the soft labels from which the final span classifier is trained. The
classifier sees the votes and two shape features. Base spans always stay; it decides on the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erspark.llm.common import joined_spans, kept_columns, materialize, packed, read_table, unpacked

LOCAL = "A-Za-z0-9._%+-"


@dataclass(frozen=True)
class Kind:
    """A kind of span.

    ``pattern`` finds the leftmost non-overlapping candidates; repeated groups in it are possessive, which keeps long
    matches off the stack. ``needs`` is a character without which nothing matches. ``part`` extracts what the gazetteer is
    asked for (its first group, in lower case); ``unlisted`` kinds are voted for if it does not stand there.
    """

    name: str
    pattern: str
    needs: str
    words: str
    part: str
    gazetteer: tuple[str, ...]
    base: bool = False
    unlisted: bool = False


# Gazetteers. Top-level domains in common use; IPv4 blocks that are no public host (first octets);
# card issuer digits; country calling codes; SSN areas never given out; first digits of area codes; IBAN countries; given names.
DOMAINS = tuple("com org net edu gov mil int info biz io co me tv app dev ai eu uk us ca de at ch fr be nl lu es pt it ie dk se no fi pl cz sk hu ro bg gr hr si lt lv ee ru ua tr il in cn jp kr tw hk sg my th vn id ph au nz za eg ma ng ke br ar mx cl pe".split())
NO_HOSTS = tuple("0 127 169 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249 250 251 252 253 254 255".split())
ISSUERS = tuple("34 37 36 38 30 40 41 42 43 44 45 46 47 48 49 51 52 53 54 55 22 23 24 25 26 27 35 60 62 64 65 50 56 57 58 63 67".split())
CALLING = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
NO_AREAS = tuple("000 666".split()) + tuple(str(n) for n in range(900, 1000))
IBAN_COUNTRIES = tuple("ad ae al at az ba be bg bh br by ch cr cy cz de dk do ee eg es fi fo fr gb ge gi gl gr gt hr hu ie il iq is it jo kw kz lb lc li lt lu lv mc md me mk mr mt mu nl no pk pl ps pt qa ro rs sa sc se si sk sm st sv tl tn tr ua va vg xk".split())
NAMES = tuple(
    """aaron adam alan albert alejandro alexander alice amanda amy ana andrea andrew angela anja anna anne anthony antonio barbara benjamin
    brian carlos carmen carol caroline catherine charles charlotte christian christine claire claudia daniel david diana diego elena
    elizabeth emily emma eric eva felix fernando francisco francois frank frederic george hannah hans heather helen helga henry hugo ines
    isabel jack jacques james jan jane jason javier jean jennifer jessica joan john jorge jose joseph juan julia julie jurgen karen karl
    katharina kevin klaus laura lena linda louis lucas lucia luis maria marie mark markus martin mary matthew michael miguel monica nancy
    nicolas nicole olivia pablo pamela patricia paul paula pedro peter philippe pierre rachel ralf raul rebecca richard robert rosa sabine
    sandra sara sarah simon sofia sophie stefan stephen steven susan susanne theresa thomas ursula victor werner william wolfgang""".split()
)
PHONE_WORDS = "phone|tel|call|mobile|fax|anruf|llam|cell|handy|movil|portable"

#: Kinds, patterns, context words. Base kinds first, in the order that breaks ties.
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "mail|contact|write|schreib|correo|courriel", r"\.([A-Za-z0-9-]+)$", DOMAINS, True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|address|host|server|adresse|direcci", r"^0*([0-9]+)\.", NO_HOSTS, True, True),
    Kind("card", r"[0-9](?:[ -]?[0-9]){13,}+", "", "card|visa|credit|pay|karte|tarjeta|carte", r"^([0-9]{2})", ISSUERS, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", PHONE_WORDS, r"^\+(1|7|[0-9]{2})", CALLING, True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social|security|tax", r"^([0-9]{3})", NO_AREAS, unlisted=True),
    Kind("tel", r"(?<![0-9+(.-])(?<![0-9)] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "", PHONE_WORDS, r"^\(?([0-9])", ("0", "1"), unlisted=True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", "iban|bank|konto|account|cuenta|compte", r"^([A-Z]{2})", IBAN_COUNTRIES),
    Kind("name", r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Don|Doña|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme|Mlle)\.? \p{Lu}\p{L}++(?: \p{Lu}\p{L}++){0,2}+", " ", "dear|name|contact|signed|regards|hello|sehr|lieber|liebe|querid|estimad|cher", r" (\p{Lu}\p{L}+)", NAMES),
)
BASE = sum(k.base for k in KINDS)
#: Code points before a span that the context labeler reads.
CONTEXT = 40
FEATURES = ("format", "listed", "context", "long", "apart")


#: Matches whose places are summed up in one go; a text of very many matches is summed block by block.
STEP = 256


def _sums(lengths: Column, first: Column) -> Column:
    """Running sums of an array, from ``first`` on."""
    none = F.struct(first.cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")), lambda acc: acc["out"])


def located(df: DataFrame, kind: Kind) -> DataFrame:
    """``df`` with ``__s_<kind>``: structs start, ord, kind, end, m of the matches ``__m_<kind>``, from their lengths and those of
    the texts between them, ``__p_<kind>``. Sums run in blocks, so that time stays far from the square of the matches."""
    m, p, n, t, s = (f"__{x}_{kind.name}" for x in "mpnts")
    blocks = F.when(F.size(m) > 0, F.sequence(F.lit(0), ((F.size(m) - 1) / STEP).cast("int"))).otherwise(F.array().cast("array<int>"))
    part = lambda b: F.slice(F.col(n), b * STEP + 1, F.lit(STEP))
    df = df.withColumn(n, F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, x: F.length(a) + F.length(x)))
    total = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0).cast("long"), lambda a, x: a + x))
    df = df.withColumn(t, F.concat(F.array(F.lit(0).cast("long")), _sums(total, F.lit(0))))
    ends = F.flatten(F.transform(blocks, lambda b: _sums(part(b), F.get(t, b))))
    order = [k.name for k in KINDS].index(kind.name)
    made = lambda e, x: F.struct((e - F.length(x)).alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), e.alias("end"), x.alias("m"))
    return df.withColumn(s, F.zip_with(ends, m, made))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: Kind, m: Column) -> Column:
    """The check that a candidate of a kind must pass; a candidate that fails is dropped."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind.name == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.name == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind.name == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def well_formed(kind: Kind, m: Column) -> Column:
    """The format labeler's vote."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {
        "email": m.rlike(r"^[A-Za-z0-9][^@]*@.*\.[A-Za-z]{2,}$") & ~m.contains(".."),
        "ip": ~m.rlike(r"(^|\.)0[0-9]"),
        "card": F.length(digits).isin(15, 16),
        "phone": m.rlike(r"[ ().-]"),
        "ssn": ~m.rlike(r"-00-|-0000$"),
        "tel": m.rlike(r"^\([0-9]{3}\) |^[0-9]{3}([ .-])[0-9]{3}\1"),
        "iban": F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34),
        "name": m.rlike(r"^(Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme|Mlle)\. |^(Miss|Herr|Frau|Don|Doña|Señora?|Monsieur|Madame) ") & m.rlike(r" \p{L}{2,20}( \p{L}{2,20})*$"),
    }[kind.name]


def accepting(kind: Kind) -> Callable[[Column], Column]:
    return lambda s: passes(kind, s["m"])


def featured(kind: Kind, body: Column) -> Callable[[Column], Column]:
    """A span's struct without its text, with the three votes and the two shape features."""

    def features(s: Column) -> Column:
        before = F.lower(F.substr(body, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(s["start"], F.lit(CONTEXT)).cast("int")))
        return F.struct(
            *(s[x].alias(x) for x in ("start", "ord", "kind", "end")),
            well_formed(kind, s["m"]).cast("int").alias("format"),
            (F.lower(F.regexp_extract(s["m"], kind.part, 1)).isin(*kind.gazetteer) != F.lit(kind.unlisted)).cast("int").alias("listed"),
            before.rlike(kind.words).cast("int").alias("context"),
            (s["end"] - s["start"] > 16).cast("int").alias("long"),
            before.rlike(r"(^|[\s:;,(\[<\"'])$").cast("int").alias("apart"),
        )

    return features


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``spans`` (in place of a column of that name): every candidate that passes, with its features.

    Null texts are empty. A text is searched for a kind only if it has the character that the kind needs.
    """
    keep = kept_columns(docs, text, "spans")
    body = F.col("__text")
    empty = F.array().cast("array<string>")
    found = {}
    for k in KINDS:
        search = F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))
        found[f"__m_{k.name}"] = F.when(F.contains(body, F.lit(k.needs)), search).otherwise(empty) if k.needs else search
    df = packed(docs, keep, text).withColumns(found)
    df = df.withColumns({f"__p_{k.name}": F.when(F.size(f"__m_{k.name}") > 0, F.split(body, k.pattern)).otherwise(empty) for k in KINDS})
    for k in KINDS:
        df = located(df, k)
    spans = [F.transform(F.filter(F.col(f"__s_{k.name}"), accepting(k)), featured(k, body)) for k in KINDS]
    return df.select(*unpacked(keep), F.concat(*spans).alias("spans"))


def fit_votes(counts: list[tuple[tuple[int, int, int], int]], rounds: int = 2000) -> dict[tuple[int, int, int], float]:
    """Posterior of being personal data for each vote pattern of one kind, by expectation-maximisation.

    Two classes, labelers independent in a class. It starts from labelers that are right four times in five.
    """
    share, hit, false = 0.5, [0.8] * 3, [0.2] * 3
    posterior, before = {}, {}
    for _ in range(rounds):
        for votes in product((0, 1), repeat=3):
            yes = share * math.prod(h if v else 1 - h for v, h in zip(votes, hit, strict=True))
            no = (1 - share) * math.prod(f if v else 1 - f for v, f in zip(votes, false, strict=True))
            posterior[votes] = yes / (yes + no)
        total = sum(c for _, c in counts)
        if not total or (before and max(abs(posterior[v] - before[v]) for v in posterior) < 1e-6):
            break
        before = dict(posterior)
        weight = sum(c * posterior[v] for v, c in counts)
        share = min(0.99, max(0.01, weight / total))
        for i in range(3):  # one pseudo-count on each side keeps rates inside (0, 1)
            hit[i] = (4 + sum(c * posterior[v] for v, c in counts if v[i])) / (5 + weight)
            false[i] = (1 + sum(c * (1 - posterior[v]) for v, c in counts if v[i])) / (5 + total - weight)
    return posterior


def train(patterns: list[tuple[str, tuple[int, ...], int]]) -> dict[str, float]:
    """Probability for ``kind`` and feature pattern, keyed ``kind:01101``: naive Bayes on the posteriors of the votes."""
    out = {}
    for kind in KINDS:
        own = [(f, c) for k, f, c in patterns if k == kind.name]
        votes: dict[tuple, int] = {}
        for f, c in own:
            votes[f[:3]] = votes.get(f[:3], 0) + c
        soft = fit_votes(list(votes.items()))
        yes = sum(c * soft[f[:3]] for f, c in own)
        no = sum(c for _, c in own) - yes
        for f in product((0, 1), repeat=len(FEATURES)):
            score = math.log((yes + 1) / (no + 1))
            for i, v in enumerate(f):
                a = (1 + sum(c * soft[g[:3]] for g, c in own if g[i] == v)) / (2 + yes)
                b = (1 + sum(c * (1 - soft[g[:3]]) for g, c in own if g[i] == v)) / (2 + no)
                score += math.log(a / b)
            out[f"{kind.name}:{''.join(map(str, f))}"] = 1 / (1 + math.exp(-max(-50.0, min(50.0, score))))
    return out


def detect(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without its text, with ``spans`` (struct start, ord, kind, end, p): base spans, and others with p >= least.

    Candidates are written once. Only the counts of feature patterns come to the driver: 32 for each kind at most, however
    many documents there are.
    """
    df = materialize(candidates(docs, text), "pii")
    votes = df.select(F.explode("spans").alias("s")).groupBy("s.kind", *[f"s.{f}" for f in FEATURES]).count().collect()
    model = train([(r["kind"], tuple(r[f] for f in FEATURES), r["count"]) for r in votes])
    table = F.create_map(*[F.lit(x) for kv in sorted(model.items()) for x in kv])
    scored = F.transform("spans", lambda s: F.struct(*(s[x].alias(x) for x in ("start", "ord", "kind", "end")), F.element_at(table, F.concat(s["kind"], F.lit(":"), *[s[f].cast("string") for f in FEATURES])).alias("p")))
    return df.withColumn("spans", F.filter(scored, lambda s: (s["ord"] < BASE) | (s["p"] >= least)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``.

    Null texts count as empty; a text of any length is searched whole; rows come back one for one, repeated ones too, and each
    counts in the estimate; spans that start together are in the order of the kinds, and a probability of exactly one half is
    enough; an empty table gives no rows. Columns besides doc_id and text are not read.
    """
    df = detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return df.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base],
        F.sha2(joined_spans(F.filter("spans", lambda s: s["ord"] < BASE)), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
