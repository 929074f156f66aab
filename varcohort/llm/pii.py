"""Operator 7: personal data by weak supervision, in DataFrame functions only.

Base spans are what the four strict patterns and their validity tests find. Wider patterns propose further
candidates. Labelers (strict form, validity, gazetteer, context, border) each vote for, against or not at all;
expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and each
pattern's posterior, and a logistic span classifier is fitted to those posteriors. Candidates that it accepts
are added to the base spans. Votes are formed in the row, so no text is moved; only the counts of vote
patterns, a few thousand at most whatever the input, go to the driver.

Every labeler may vote for, vote against or abstain, and has a share of each for true spans and for others. The
estimate is that of the two-class mixture with Dirichlet priors: before any data a labeler is held to be right more
often than wrong, and the data move all of its shares, what its silence weighs included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_matches, cut

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns, written so that no position is tried twice: possessive, and begun where a run of the
#: characters begins or the last match ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[\p{L}\p{N}-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[\p{L}\p{N}-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?|\[\.\])[0-9]{1,3}(?:\x20?\.\x20?|\[\.\])[0-9]{1,3}(?:\x20?\.\x20?|\[\.\])[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}([._/\x20-]{1,2}+)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
#: What must occur in a text for the kind's patterns to be tried at all.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.|[0-9]\x20\.|[0-9]\[\.", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"[0-9]"}
#: Generic top-level domains (any two letters are a country's), and numbers that are no one's.
ENDINGS = ("academy agency app art asia biz blog cat center cloud club com company coop design dev edu email eu finance gov group guru health help "
           "host info int jobs law life live media mil mobi money museum name net network news ngo one online org page post press pro "
           "report school science services shop site social software solutions space store studio support systems team tech tel today tools top travel "
           "university video web website wiki work world xyz zone").split()  # fmt: skip
RESERVED_IP = r"^0*(0|10|127|22[4-9]|2[34][0-9]|25[0-5])\.|^0*169\.0*254\.|^0*172\.0*(1[6-9]|2[0-9]|3[01])\.|^0*192\.0*168\."
ISSUERS = r"^(4|5[0-8]|6[0-9]|2[2-7]|3[0-9]|81|9[0-9])"
CALLING = r"^\+?(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
#: Words before a span that speak for it and against it, in English, German, French and Spanish.
CONTEXT = {
    "email": (r"(?i)e-?mail|contact|write|mailto|reach|kontakt|schreib|\bmail|correo|courriel|adresse|escrib|écri|@", r"(?i)version|branch|commit|handle"),
    "ip": (r"(?i)\bip\b|address|host|server|client|from|adresse|dirección|servidor|serveur|login", r"(?i)version|section|chapter|release|kapitel|sección|chapitre|\bv"),
    "card": (r"(?i)card|visa|master|amex|payment|credit|karte|zahlung|tarjeta|pago|carte|paiement", r"(?i)isbn|order|serial|tracking|invoice|part|rechnung|factura|facture|pedido"),
    "phone": (r"(?i)phone|tel|call|mobile|fax|contact|anruf|handy|llama|móvil|appel|portable", r"(?i)isbn|order|serial|version|date|bestell|pedido|commande|datum|fecha"),
}
LABELERS = ("strict", "valid", "gazetteer", "context", "border")
REACH = 32


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The base test of a strict match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    n = F.length(digits(value))
    return n.between(16, 19) & luhn(digits(value)) if kind == "card" else n.between(8, 15)


def vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def candidates(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, base, votes, size) for one kind: base spans, then wider ones that touch none."""

    def known(value: Column) -> tuple[Column, Column]:
        if kind == "email":
            end = F.lower(F.regexp_extract(value, r"([\p{L}\p{N}-]+)$", 1))
            return end.isin(*ENDINGS) | end.rlike("^[a-z]{2}$"), end.rlike("^[0-9]+$|^.$")
        if kind == "ip":
            return ~value.rlike(RESERVED_IP), value.rlike(RESERVED_IP)
        if kind == "card":
            return digits(value).rlike(ISSUERS), ~digits(value).rlike(ISSUERS)
        return value.rlike(r"^\(") | (value.startswith("+") & value.rlike(CALLING)), value.startswith("+") & ~value.rlike(CALLING)

    def made(m: Column, base: bool) -> Column:
        before = F.substring(text, F.greatest(m["start"] - REACH, F.lit(0)) + 1, F.least(m["start"], F.lit(REACH)))
        around = F.concat(F.substring(before, -1, 1), F.lit("\n"), F.substring(text, m["end"] + 1, 1))
        good, bad = CONTEXT[kind]
        sound = valid(kind, F.regexp_replace(m["value"], r"\[\.\]|\x20", ".") if kind == "ip" and not base else m["value"])
        votes = (F.lit(1 if base else -1), vote(sound, ~sound), vote(*known(m["value"])), vote(before.rlike(good), before.rlike(bad)), vote(~around.rlike(r"[\p{L}\p{N}_@]"), around.rlike(r"[\p{L}\p{N}_@]")))
        size = F.least(F.length(m["value"]) / 8, F.lit(4)).cast("int")
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(base).alias("base"), *[v.cast("int").alias(n) for n, v in zip(LABELERS, votes, strict=True)], size.alias("size"))

    strict = F.transform(F.filter(all_matches(text, STRICT[kind]), lambda m: valid(kind, m["value"])), lambda m: made(m, True))
    wide = F.transform(all_matches(text, WIDE[kind]), lambda m: made(m, False))
    apart = F.filter(wide, lambda w: ~F.exists(strict, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    both = F.concat(strict, apart)
    return F.when(text.rlike(NEEDS[kind]), both).otherwise(F.array().cast(CANDIDATES))


CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean," + ",".join(f"{n}:int" for n in LABELERS) + ",size:int>>"


#: Pseudo-counts of a labeler's votes before any data: right, silent, wrong.
PRIOR = (4.0, 2.0, 1.0)


def likelihood(votes: np.ndarray, shares: np.ndarray, prior: float) -> np.ndarray:
    """Log joint of each vote pattern with either class; ``shares[class, labeler, vote + 1]``."""
    at = np.arange(votes.shape[1])
    return np.stack([np.log(p) + np.log(shares[c][at, votes + 1]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))])


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(posterior of each vote pattern, shares, objectives) of the two-class mixture of independent labelers.

    Patterns are rows of -1, 0, 1. The objective, log likelihood and log prior, never falls from one round to the next.
    """
    pseudo = np.array([PRIOR, PRIOR[::-1]])  # votes -1, 0, 1 for false spans, then for true ones
    post, seen = 1 / (1 + np.exp(-votes.sum(axis=1, dtype=float))), []
    one = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds):
        prior = (counts @ post + 1) / (counts.sum() + 2)
        shares = np.stack([np.einsum("p,pjv->jv", counts * w, one) + pseudo[c] for c, w in ((0, 1 - post), (1, post))])
        shares /= shares.sum(axis=2, keepdims=True)
        joint = likelihood(votes, shares, prior)
        top = joint.max(axis=0)
        both = top + np.log(np.exp(joint - top).sum(axis=0))
        seen.append(float(counts @ both + (pseudo[:, None, :] * np.log(shares)).sum() + np.log(prior) + np.log(1 - prior)))
        post = np.exp(joint[1] - both)
        if len(seen) > 1 and seen[-1] - seen[-2] < 1e-9 * abs(seen[-1]):
            break
    return post, shares, seen


def features(kind: str, votes: tuple, size: int) -> dict[str, float]:
    return {"one": 1.0, f"kind={kind}": 1.0, f"size={size}": 1.0} | {f"{n}={v}": 1.0 for n, v in zip(LABELERS, votes, strict=True) if v}


def fit(rows: list[dict[str, float]], target: np.ndarray, weight: np.ndarray, rounds: int = 300, ridge: float = 1e-2) -> dict[str, float]:
    """Logistic regression on weighted soft labels, by gradient steps of bounded length."""
    names = sorted({k for r in rows for k in r})
    x = np.array([[r.get(n, 0.0) for n in names] for r in rows])
    w, weight = np.zeros(len(names)), weight / weight.sum()
    step = 4 / (x**2).sum(axis=1).max()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= step * (x.T @ (weight * (p - target)) + ridge * w / len(rows))
    return dict(zip(names, w.tolist(), strict=True))


def train(found: DataFrame) -> dict[str, float]:
    """The span classifier's weights, from all candidates' vote patterns."""
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", *[f"c.{n}" for n in LABELERS], "c.size").count().collect()
    if not rows:
        return {"one": 0.0}
    rows = sorted(rows, key=lambda r: tuple(map(str, r)))
    posterior = np.zeros(len(rows))
    for kind in KINDS:
        at = [i for i, r in enumerate(rows) if r["kind"] == kind]
        if at:
            votes = np.array([[rows[i][n] for n in LABELERS] for i in at])
            posterior[at] = expectation_maximisation(votes, np.array([rows[i]["count"] for i in at], dtype=float))[0]
    made = [features(r["kind"], tuple(r[n] for n in LABELERS), r["size"]) for r in rows]
    return fit(made, posterior, np.array([r["count"] for r in rows], dtype=float))


def probability(c: Column, weights: dict[str, float]) -> Column:
    score = F.lit(weights.get("one", 0.0))
    for name in ("kind", "size", *LABELERS):
        chain = None
        for key, w in weights.items():
            if key.startswith(f"{name}="):
                hit = c[name].cast("string") == key.partition("=")[2]
                chain = F.when(hit, F.lit(w)) if chain is None else chain.when(hit, F.lit(w))
        if chain is not None:
            score = score + chain.otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document.

    Null texts are empty and have no span; a null doc_id keeps its row, repeated rows give repeated results, an
    empty table gives none; further columns are ignored. Base spans always stay.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = cut(docs.select("doc_id", F.concat(*[candidates(text, k) for k in KINDS]).alias("found")), "candidates")
    weights = train(found)
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])

    def joined(base_only: bool) -> Column:
        keep = F.filter("found", lambda c: c["base"] if base_only else c["base"] | (probability(c, weights) >= threshold))
        by = F.array_sort(F.transform(keep, lambda c: F.struct(rank[c["kind"]].alias("rank"), c["start"].alias("start"), F.concat_ws(":", c["kind"], c["start"], c["end"]).alias("text"))))
        return F.array_join(F.transform(by, lambda s: s["text"]), ",")

    count = lambda kind: F.size(F.filter("found", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(True), 256).alias("base_sha256"), joined(False).alias("spans"))

