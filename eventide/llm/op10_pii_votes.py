"""Personal data by weak supervision.

Regular expressions propose spans. Labelers vote yes, no or abstain on each: the inner form of the match (check digits,
number plans), gazetteers of mail domains, calling codes, area codes, networks and banks' countries, the words before it,
and its length. Any of them can be wrong about a base span as about another. How reliable each labeler is comes from expectation-maximisation
over the counts of vote patterns; its posteriors train a logistic span classifier, which decides on the candidates that
no base pattern fixes. Texts are read once; models see counts of patterns, of which there are a few thousand at most.
Built-in functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import apart, let, piece, spans_of, stored, text_blocks

BASE = ("email", "ip", "card", "phone")
# \G: a match may also begin where the one before it ended; possessive repeats keep long runs linear
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates beyond the base: local phone numbers, social security numbers, handles, account numbers.
#: A local number begins where no digit, plus sign, or digit and separator stand before; after another one and a space; or
#: at a bracket.
LOCAL = r"(?:(?<![0-9+])[(]|(?<![0-9+]|[0-9][\x20.-])|(?<=[0-9]{3}[\x20.-][0-9]{4}\x20))[0-9]{3}[)]?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
HANDLE = r"(?<![A-Za-z0-9._%+-])@[A-Za-z][A-Za-z0-9_]{2,}+"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
MORE = ("localphone", "social", "handle", "account")
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# Public lists of mail domains (first label), country calling codes, first
# numbers of private and documentation networks, countries of account numbers, first digits of card issuers.
MAIL_DOMAINS = (
    "aol att bellsouth btinternet charter comcast cox earthlink example fastmail free gmail gmx googlemail hotmail icloud inbox "
    "juno laposte libero live mac mail mailbox me msn naver ntlworld orange outlook pobox posteo proton protonmail qq rediffmail "
    "rocketmail rogers sbcglobal seznam sfr shaw sky sympatico t-online talktalk tiscali tutanota verizon virgilio virgin wanadoo "
    "web yahoo yandex ymail zoho"
).split()
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 "
    "93 94 95 98 212 213 216 218 220 221 225 233 234 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 "
    "375 380 381 385 386 387 389 420 421 852 853 855 880 886 961 962 963 964 965 966 968 971 972 973 974 977 992 994 995 998"
).split()
NETWORKS = "10 100 127 169 172 192 198 203".split()
ACCOUNT_COUNTRIES = (
    "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT KW KZ LB LI LT LU LV MC "
    "MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK"
).split()
CARD_ISSUERS = "30 34 35 36 37 38 40 41 42 43 44 45 46 47 48 49 50 51 52 53 54 55 60 62 64 65".split()
#: Area codes of the North American plan: no leading 0 or 1, no 9 in the middle, no service codes.
AREA_PLAN = "^[2-9](?!11)[0-8][0-9]"
#: Context words.
CONTEXT = r"(?i)(?:e-?mail|mail|contact|phone|tel|call|fax|mobile|card|visa|iban|account|ssn|social|ip|host|server|user|follow)[^\n]{0,20}$"
AGAINST = r"(?i)(?:version|isbn|page|figure|section|order|invoice|total|price)[^\n]{0,12}$"
BEFORE = 32
LABELERS = ("form", "gazetteer", "context", "length")
ROUNDS, STEPS, RATE = 40, 400, 0.5
THRESHOLD = 0.5


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check: from the right, every second one doubled and its digits added."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def _form(kind: Column, value: Column) -> Column:
    """A vote on the inner form, whatever the kind is worth otherwise."""
    digits = _digits(value)
    same = value.rlike(r"(.)\1{5}")
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))  # an account number's check digits go last
    letter = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.try_to_number(c, F.lit("9")).cast("int"))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + F.coalesce(letter(c), F.lit(0))) % 97)
    good = (
        F.when(kind == "email", value.rlike(r"[A-Za-z0-9]@.*\.[A-Za-z]{2,10}$"))
        .when(kind == "ip", value.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?:0|[1-9][0-9]{0,2})){3}$"))
        .when(kind == "card", value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"))
        .when(kind == "phone", F.char_length(digits).between(10, 13) & value.rlike(r"^[^()]*(?:[(][0-9]+[)][^()]*)?$"))
        .when(kind == "localphone", digits.rlike("^.{3}[2-9]"))
        .when(kind == "social", ~value.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "handle", F.char_length(value).between(4, 31))
        .otherwise(rest == 1)
    )
    return _vote(good & ~same, ~good | same)


def _gazetteer(kind: Column, value: Column) -> Column:
    """A vote by lists: yes for what they have, no for numbers outside of a complete plan."""
    digits = _digits(value)
    listed = (
        F.when(kind == "email", F.regexp_replace(F.lower(F.regexp_extract(value, "@([A-Za-z0-9-]+)", 1)), "[0-9]+$", "").isin(MAIL_DOMAINS))
        .when(kind == "ip", F.substring_index(value, ".", 1).isin(NETWORKS))
        .when(kind == "card", F.substring(digits, 1, 2).isin(CARD_ISSUERS))
        .when(kind == "phone", F.substring(digits, 1, 1).isin(CALLING_CODES) | F.substring(digits, 1, 2).isin(CALLING_CODES) | F.substring(digits, 1, 3).isin(CALLING_CODES))
        .when(kind == "localphone", digits.rlike(AREA_PLAN))
        .when(kind == "account", F.substring(value, 1, 2).isin(ACCOUNT_COUNTRIES))
        .otherwise(F.lit(False))
    )
    return _vote(listed, ~listed & kind.isin("card", "phone", "localphone", "account"))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with `_base` and `_more`: arrays of struct(kind, start, end, votes, traits), the candidates with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ip = F.filter(spans_of(text, IP, "ip"), lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    cards = F.filter(spans_of(text, CARD, "card"), lambda s: F.char_length(s["value"]) >= 13)
    card = F.filter(cards, lambda s: F.char_length(_digits(s["value"])).between(13, 19) & luhn(_digits(s["value"])))
    phone = F.filter(spans_of(text, PHONE, "phone"), lambda s: F.char_length(_digits(s["value"])).between(9, 15))
    more = F.concat(spans_of(text, LOCAL, "localphone"), spans_of(text, SOCIAL, "social"), spans_of(text, HANDLE, "handle"), spans_of(text, ACCOUNT, "account"))

    def judged(s: Column, blocks: Column) -> Column:
        value, kind, length = s["value"], s["kind"], F.char_length(s["value"])
        words = piece(blocks, F.greatest(F.lit(0), s["start"] - BEFORE), s["start"])
        votes = let(words, lambda w: F.concat(_form(kind, value), _gazetteer(kind, value), _vote(w.rlike(CONTEXT), w.rlike(AGAINST)), _vote(length.between(9, 30), length < 6)))
        traits = F.concat(
            F.when(kind.isin("email", "handle"), "1").otherwise("0"),
            F.when(kind.isin("phone", "localphone", "social"), "1").otherwise("0"),
            F.when(kind.isin("card", "account"), "1").otherwise("0"),
            F.when(length > 14, "1").otherwise("0"),
            F.when(value.rlike("[A-Za-z]"), "1").otherwise("0"),
        )
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), votes.alias("votes"), traits.alias("traits"))

    def all_judged(spans: Column) -> Column:
        return F.when(F.size(spans) > 0, let(text_blocks(text), lambda blocks: F.transform(spans, lambda s: judged(s, blocks))))

    none = F.array().cast("array<struct<kind:string,start:int,end:int,votes:string,traits:string>>")
    kinds = [F.col(f"_{k}") for k in BASE]
    out = docs.select("*", spans_of(text, EMAIL, "email").alias("_email"), ip.alias("_ip"), card.alias("_card"), phone.alias("_phone"), more.alias("_more"))
    out = out.withColumn("_more", apart(F.col("_more"), *kinds)).withColumn("_base", F.concat(*kinds)).drop(*[f"_{k}" for k in BASE])
    return out.withColumn("_base", F.coalesce(all_judged(F.col("_base")), none)).withColumn("_more", F.coalesce(all_judged(F.col("_more")), none))


def reliabilities(patterns: dict[str, float]) -> tuple[float, list[list[list[float]]]]:
    """Expectation-maximisation over counts of vote patterns ('1' yes, '2' no, '0' abstains, a place a labeler): the prior
    of a true span, and for each labeler the chances of its votes on false and on true spans."""
    chances = [[[0.5, 0.2, 0.3], [0.4, 0.5, 0.1]] for _ in LABELERS]
    prior, total = 0.6, sum(patterns.values())
    for _ in range(ROUNDS if total else 0):
        sums = [[[0.1] * 3, [0.1] * 3] for _ in LABELERS]
        positive = 0.0
        for votes, n in patterns.items():
            p = posterior(votes, prior, chances)
            positive += n * p
            for i, v in enumerate(votes):
                sums[i][1][int(v)] += n * p
                sums[i][0][int(v)] += n * (1 - p)
        prior = min(0.99, max(0.01, positive / total))
        chances = [[[x / sum(side) for x in side] for side in own] for own in sums]
    return prior, chances


def posterior(votes: str, prior: float, chances: list) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for i, v in enumerate(votes):
        yes, no = yes + math.log(chances[i][1][int(v)]), no + math.log(chances[i][0][int(v)])
    return 1 / (1 + math.exp(max(-700.0, min(700.0, no - yes))))


def inputs(votes: str, traits: str) -> list[float]:
    return [1.0, *(float(v == w) for v in votes for w in "12"), *(float(t) for t in traits)]


def span_classifier(counts: dict[tuple[str, str], float]) -> list[float]:
    """Weights of a logistic model of the posteriors, fitted on counts of (votes, traits)."""
    by_votes: dict[str, float] = {}
    for (votes, _), n in counts.items():
        by_votes[votes] = by_votes.get(votes, 0.0) + n
    prior, chances = reliabilities(by_votes)
    rows = [(inputs(v, t), posterior(v, prior, chances), n) for (v, t), n in sorted(counts.items())]
    width, total = len(inputs("0" * len(LABELERS), "0" * 5)), sum(counts.values())
    w = [0.0] * width
    for _ in range(STEPS if total else 0):
        slope = [1e-4 * x for x in w]
        for x, p, n in rows:
            g = (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - p) * n / total
            for i, v in enumerate(x):
                slope[i] += g * v
        w = [a - RATE * b for a, b in zip(w, slope)]
    return w


def _said(spans: Column, order: tuple[str, ...]) -> Column:
    place = F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(place[s["kind"]].alias("a"), s["start"].alias("b"), s["end"].alias("c"), s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["b"], s["c"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more, n_spans; one row a document row.

    Base spans always stay; further candidates are added where the span classifier gives at least one half. Null and empty
    texts have no spans; without any candidate in the table nothing is learnt and nothing added. Repeated rows get equal
    spans; very long texts are scanned whole; spans of one place keep the order of their kinds; no rows give none. Other
    columns are ignored."""
    rows = stored(scanned(docs.select("doc_id", "text")).drop("text"), "candidates")
    each = rows.select(F.explode(F.concat("_base", "_more")).alias("s"))
    counts = {(r.votes, r.traits): float(r.n) for r in each.groupBy("s.votes", "s.traits").agg(F.count("*").alias("n")).collect()}  # 3**4 * 2**5 at most
    w = span_classifier(counts)
    chosen = sorted(f"{v}{t}" for (v, t) in counts if 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, inputs(v, t))))))) >= THRESHOLD)
    added = F.filter("_more", lambda s: F.array_contains(F.array(*[F.lit(c) for c in chosen]).cast("array<string>"), F.concat(s["votes"], s["traits"])))
    out = rows.withColumn("_added", added)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(_said(F.col("_base"), BASE), 256).alias("base_sha256"),
        _said(F.concat("_base", "_added"), (*BASE, *MORE)).alias("spans"),
        F.size("_added").cast("long").alias("n_more"),
        (F.size("_base") + F.size("_added")).cast("long").alias("n_spans"),
    )
