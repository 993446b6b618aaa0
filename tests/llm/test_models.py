"""The models' own work: spans that the trees add, and the risk of positive-unlabelled learning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import pii, toxicity

#: By kind: sentences with a span of it, and sentences with something that looks like one.
PLANTED = {
    "account": (
        ["Please pay to IBAN {}", "account {} today", "acct {}, thanks", "IBAN: {}"], ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NL91ABNA0417164300"],
        ["part number {}", "serial {} is broken", "batch {}", "key {}"], ["DE12345678901234567890", "GB00ABCD12345698765432", "FR9999999999KTZQXW", "NL12SERIAL123456789"],
    ),
    "national_id": (
        ["my SSN is {}", "SSN {}", "social security {}", "ssn: {}"], ["123-45-6789", "078-05-1120", "219-09-9999", "457-55-5462"],
        ["order {}", "docket {} was closed", "part {}", "build {}"], ["987-65-4321", "000-12-3456", "666-45-6789", "123-00-4567"],
    ),
    "local_phone": (
        ["call {}", "tel {} or later", "phone: {}", "my number is {}"], ["(212) 555-0142", "415-555-2671", "303.555.9087", "(617) 253-1000"],
        ["order {}", "serial {}", "tracking {}", "version {}"], ["112-034-0001", "012-345-6789", "199.001.2300", "100-100-1000"],
    ),
    "loose_email": (
        ["write to {}", "e-mail: {}", "contact {}", "email {}"], ["jörg@münchen.de", "o.diaz@straße.org", "kim7@почта.рф", "li-na@exämple.info"],
        ["git clone {}", "handle {}", "see {}", "ref {}"], ["user@host", "a@refs/heads", "x=@12", "{var}@home:path"],
    ),
}


def planted():
    right, wrong = [], []
    for kind, (said, values, unsaid, looks) in PLANTED.items():
        right += [(s.format(v), kind, s.index("{}"), s.index("{}") + len(v)) for s in said for v in values]
        wrong += [(s.format(v), kind) for s in unsaid for v in looks]
    return right, wrong


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["spans"] if not s["base"]} for r in pii.detect(rows).collect()}


def test_added_spans_by_kind(spark):
    """Precision and recall of what the trees add, by kind, on sentences that are not among their findings."""
    right, wrong = planted()
    got = found(spark, [t for t, *_ in right] + [t for t, _ in wrong])
    for kind in PLANTED:
        mine = [k for k, r in enumerate(right) if r[1] == kind]
        hit = sum((kind, right[k][2], right[k][3]) in got[k] for k in mine)
        said = hit + sum(len(got[len(right) + k]) for k, w in enumerate(wrong) if w[1] == kind) + sum(len({s for s in got[k] if s != (kind, right[k][2], right[k][3])}) for k in mine)
        print(f"{kind}: recall {hit}/{len(mine)}, {said} added")
        assert hit >= 0.7 * len(mine) and hit >= 0.85 * said, kind


def test_nothing_is_added_without_the_trees(spark, monkeypatch):
    """Candidates alone are no spans: with trees that know nothing, all are refused, and with bars of nothing, look-alikes come in."""
    right, wrong = planted()
    base, _, least = pii.fit(spark)
    monkeypatch.setattr(pii, "fit", lambda spark: (base, [], least))
    assert not any(found(spark, [t for t, *_ in right]).values())
    monkeypatch.setattr(pii, "fit", lambda spark: (base, [], dict.fromkeys(least, 0.0)))
    assert sum(map(bool, found(spark, [t for t, _ in wrong]).values())) > 8


def risk(w, b, xp, xu, prior):
    """Non-negative risk and its gradient, as they are written in the module's docstring, by finite differences."""
    loss = lambda x, y: np.logaddexp(0, -y * (x @ w + b)).mean()
    rest = loss(xu, -1) - prior * loss(xp, -1)
    return prior * loss(xp, +1) + max(0, rest), rest


def test_training_lowers_the_risk():
    """Against plain descent of the same risk by finite differences: as low a risk, and the same documents above one half."""
    rng = np.random.default_rng(1)
    toxic = rng.random((400, 6)) < np.array([0.9, 0.7, 0.2, 0.5, 0.5, 0.1])
    clean = rng.random((1600, 6)) < np.array([0.1, 0.2, 0.4, 0.5, 0.5, 0.3])
    xp, xu, prior = toxic[:200].astype(np.float32), np.concatenate([toxic[200:], clean]).astype(np.float32), 200 / 1800
    weights, base = toxicity.train(xp, xu, list(range(6)), prior=prior, steps=1500)
    w = np.array([weights[k] for k in range(6)])
    theta = np.r_[np.zeros(6), np.log(prior / (1 - prior))]
    for _ in range(1500):
        grad = np.array([(risk(*np.split(theta + e, [6]), xp, xu, prior)[0] - risk(*np.split(theta - e, [6]), xp, xu, prior)[0]) / 2e-4 for e in 1e-4 * np.eye(7)])
        theta -= 0.5 * grad
    mine, plain = risk(w, base, xp, xu, prior)[0], risk(theta[:6], theta[6], xp, xu, prior)[0]
    assert mine <= plain + 0.01
    said, want = xu @ w + base > 0, xu @ theta[:6] + theta[6] > 0
    assert (said == want).mean() > 0.97 and said[:200].mean() > 0.6 and said[200:].mean() < 0.05


def test_the_bracket_is_kept_from_going_negative():
    """All unlabelled texts like the positives, and a prior far too high: without the correction the bracket would fall below 0 without bound."""
    rng = np.random.default_rng(2)
    xp = (rng.random((300, 4)) < 0.5).astype(np.float32)
    xu = (rng.random((900, 4)) < 0.5).astype(np.float32)
    weights, base = toxicity.train(xp, xu, [0, 1, 2, 3], prior=0.9, steps=800)
    assert risk(np.array([weights[k] for k in range(4)]), base, xp, xu, 0.9)[1] > -0.1


@pytest.mark.parametrize("fold", ["held out"])
def test_held_out_documents(spark, fold):
    """The figures that the README states, with some room."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.classify(docs, labels).where("held_out").join(labels.where("toxic is not null").select("doc_id", "toxic"), "doc_id")
    true, said, both = got.agg(F.sum("toxic"), F.sum("predicted"), F.sum(F.col("toxic") * F.col("predicted"))).first()
    print(f"precision {both / said:.3f}, recall {both / true:.3f}")
    assert both >= 0.8 * said and both >= 0.7 * true
