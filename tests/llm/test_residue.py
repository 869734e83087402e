import os

import pytest

from stratamem.llm import residue as R
from hand_labelled import FRESH, TEXTS

CLEAN = ["The chain was reviewed by Nora in {n} hops, but the outbox took longer.", "Decision: split the root, keep the {n} edges, revisit on Friday.", "Bitte erinnere Karl am {n}. an die Übergabe.",
         "Vera reported an access denied message in ops; the ticket {n} had been closed.", "Ask what `{{{{name}}}}` means in the {n} old exports.", "L'espace contient {n} nœuds liés à Paul.", "Ines fixed the banner that told readers to enable JavaScript {n} days ago."]
BAD = {"slot": ["Dear {{{{name}}}}, your note {n} was updated.", "Assigned to [INSERT OWNER], due {n}.", "Hola ${{owner}}, tu nota {n} cambió.", "Only {n} %COUNT% were published."],
       "filler": ["Lorem ipsum dolor sit amet consectetur elit {n}.", "blah blah blah blah blah blah blah blah blah.", "owner: TBD\nname: <empty>\ndate: n/a yet\ntotal: {n} \nteam: TODO\ntitle: ..."],
       "notice": ["Please enable JavaScript to continue.", "Error 50{k}. Try again later.", "Access denied. You do not have permission to open page {n}.", "The store is down for maintenance.", "Your session has expired. Please log in again to continue."]}


def _docs():
    rows, n = [], 0
    for k in range(60):
        for i, c in enumerate(CLEAN):
            n += 1
            rows.append((n, f"Title of note {n}\n\n" + " ".join(CLEAN[(i + j) % len(CLEAN)].format(n=n + j) for j in range(3)), f"host-{n % 23}", None))
        for kind, texts in BAD.items():
            t = texts[k % len(texts)]
            n += 1
            text = t.format(n=n, k=k % 5)
            rows.append((n, text if kind == "notice" else f"# Note {n}\n\n{text}\n\n" + CLEAN[0].format(n=n), f"host-{n % 23}", kind))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_docs(), "doc_id long, text string, source string, kind string").cache()


def test_finds_residue(docs):
    want = {r["doc_id"] for r in docs.where("kind IS NOT NULL").collect()}
    have = {r["doc_id"] for r in R.residue(docs).collect()}
    assert len(have & want) >= 0.97 * len(want) and len(have - want) <= 0.02 * len(want)


def test_validates_on_unseen_hosts(docs):
    """With all features, and with the phrases that labels are given by held out of training and test."""
    report = {(r["features"], r["class"]): r for r in R.train(docs)[1].collect()}
    assert len(report) == 2 * len(R.CLASSES)
    assert all(r["precision"] >= 0.9 and r["recall"] >= 0.9 for k, r in report.items() if k[0] == "all" and r["n"])
    assert all(r["precision"] >= 0.9 for k, r in report.items() if k[1] == "clean")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data")
def test_new_wordings(spark):
    """Texts labelled by hand, on the model of the largest documents table."""
    w, known = R.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), validate=False)[0], R.Words()

    def kind(text):
        body = R._body(R.paragraphs(text))
        return R.verdict(body, [R.CLASSES[c] for c in R.classify([(u, R._where(i, len(body))) for i, (_, u) in enumerate(body)], w, known)])

    def rates(texts):
        got = [(bool(kind(t)), bool(k)) for t, k in texts]
        true = sum(a and b for a, b in got)
        return true / sum(a for a, _ in got), true / sum(b for _, b in got)

    (p, r), (p2, r2) = rates(TEXTS), rates(FRESH)
    assert p >= 0.9 and r >= 0.75 and p2 >= 0.9 and r2 >= 0.85
    assert sum(kind(t) is not None for t, k in TEXTS + FRESH if k is None) <= 4
    assert [kind(t) for t in ("Hi [Customer Name], all is well.", "Hello <<first_name>>!", "From @@NAME@@", "Ask XX_OWNER_XX for it.")] == ["slot"] * 4


def test_agreement_is_reported(docs):
    got = {r["doc_id"]: (r["kind"], r["by_labels"]) for r in R.residue(docs, labels=True).collect()}
    assert got and all(any(k) for k in got.values()) and sum(a == b for a, b in got.values()) >= 0.95 * len(got)


def test_dirty_and_empty(spark, docs):
    dirty = spark.createDataFrame([(10**6, None, None), (10**6 + 1, " \n\t", "x"), (10**6 + 2, "", "x"), (10**6 + 3, '{"a": "{b}"}', "x"), (10**6 + 4, "```\n${x}\n```", "x"), (10**6 + 5, " ".join(f"Item {i} holds value number {i * 7}." for i in range(20_000)), "x"), (None, CLEAN[0].format(n=7), None), (2**60 + 1, "Hello {{name}}, welcome.", "x"), (10**6 + 6, "Hello {{name}}, welcome.", "x"), (10**6 + 6, "Hello {{name}}, welcome.", "x")], "doc_id long, text string, source string")
    out = [r["doc_id"] for r in R.residue(docs.select("doc_id", "text", "source").union(dirty)).collect() if r["doc_id"] is None or r["doc_id"] >= 10**6]
    assert sorted(out) == [10**6 + 6, 2**60 + 1]
    assert R.residue(docs.limit(0)).count() == 0
    assert R.residue(spark.createDataFrame([(1, "All is well here.", "h")], "doc_id long, text string, source string")).count() == 0
    assert R.train(docs.limit(0))[1].count() == 0


@pytest.mark.parametrize("text,label", [("HTTP 404 Not Found", "notice"), ("name: TODO", "filler"), ("Write `{{name}}` here.", "clean"), ("She said 'your name here' twice.", "clean"), ("# {{title}}", "slot"), ("Back to top", None)])
def test_weak_labels(text, label):
    assert R.weak_label(R.paragraphs(text)[0][0]) == label


@pytest.mark.parametrize("text", ["home" + " " * 50_000 + "!", "." * 200_000, "{" * 100_000, "<pre>" * 5_000, "“" * 100_000, "a " * 300_000, "<!--" * 50_000, "<pre>" * 50_000, "<title>" * 50_000, "@a" * 100_000, "__a" * 50_000, "AB_" * 50_000, "%a b" * 50_000, "((" * 50_000, "`" * 100_001, "x" * 500_000, "Menu | " * 50_000])
def test_time_is_in_proportion(text):
    import time

    t = time.time()
    body, known = R._body(R.paragraphs(text)), R.Words()
    for _, u in body:
        R.weak_label(u)
        R._phrases(u)
    R.features([(u, "later") for _, u in body] or [("x", "alone")], known)
    assert time.time() - t < 10


def test_residue_is_found_without_sources(spark):
    """A null source is held out of the validation's model, not of the one that gives the verdicts."""
    filler = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."
    plain = "The harbour office moved its ledgers to the second floor, where the clerks keep the keys of all the older rooms."
    docs = spark.createDataFrame([(i, filler if i % 2 else f"{plain} It was the year {1900 + i}.", None) for i in range(40)], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["kind"]) for r in R.residue(docs).select("doc_id", "kind").collect()} == {(i, "filler") for i in range(1, 40, 2)}
