import datetime as dt

import pytest

from mail_rows import ids
from mailspark.operators import search
from mailspark.plans.mail_search import search_mail

SEARCHES = [
    "from:john@example.com subject:meeting important",
    'subject:"two words" rest of it',
    'subject:"x y" from:"z w"',
    "xfrom:a",
    'subject:"unclosed words',
    'label:"" kept',
    "a from:b c",
    "from:a from:b",
    'from:a from:""',
    "from_date:2024-01-01 to_date:2024-02-01 label:work",
    "rag:budget\nsubject:next line",
    "   only words \t",
    "",
]
EXPECTED = {
    SEARCHES[0]: {"from": "john@example.com", "subject": "meeting", "excerpt": "important"},
    SEARCHES[1]: {"subject": "two words", "excerpt": "rest of it"},
    SEARCHES[2]: {"subject": 'x y" from:"z w'},
    SEARCHES[3]: {"from": "a", "excerpt": "x"},
    SEARCHES[4]: {"subject": '"unclosed', "excerpt": "words"},
    SEARCHES[5]: {"excerpt": "kept"},
    SEARCHES[6]: {"from": "b", "excerpt": "a  c"},
    SEARCHES[7]: {"from": "b"},
    SEARCHES[8]: {},
    SEARCHES[9]: {"from_date": "2024-01-01", "to_date": "2024-02-01", "label": "work"},
    SEARCHES[10]: {"rag": "budget", "subject": "next", "excerpt": "line"},
    SEARCHES[11]: {"excerpt": "only words"},
    SEARCHES[12]: {},
}


@pytest.mark.parametrize("text", SEARCHES)
def test_parse_search(text):
    assert search.parse_search(text) == EXPECTED[text]


def test_parse_searches_agrees_with_the_single_form(spark):
    frame = spark.createDataFrame([(s,) for s in SEARCHES], "q string")
    for row in search.parse_searches(frame, "q").collect():
        found = row.asDict()
        criteria = {k[: -len("_filter")]: v for k, v in found.items() if k != "q" and v}
        assert criteria == EXPECTED[found["q"]]


def test_no_search_is_no_criterion():
    assert search.parse_search(None) == {}


def test_contains_is_case_sensitive_and_keeps_wildcards(emails_of):
    emails = emails_of(
        {"message_id": "1", "subject": "Invoice 100%"},
        {"message_id": "2", "subject": "invoice"},
        {"message_id": "3", "subject": r"back\slash"},
        {"message_id": "4", "subject": None},
    )
    find = lambda value: sorted(ids(emails.filter(search.contains("subject", value))))
    assert find("Inv") == ["1"]
    assert find("nv_ice") == ["1", "2"]
    assert find("In%1") == ["1"]
    assert find("k\\s") == ["3"]
    assert find("%") == ["1", "2", "3"]


def test_labels_are_matched_whole(sample):
    assert ids(search.select_matching(sample, {"label": "work"})) == ["<3@x>"]
    assert ids(search.select_matching(sample, {"label": "wor"})) == []


def test_a_label_silences_free_text(sample):
    assert ids(search.select_matching(sample, {"label": "work", "excerpt": "nowhere"})) == ["<3@x>"]
    assert ids(search.select_matching(sample, {"excerpt": "nowhere"})) == []


def test_upper_date_bound_is_midnight(sample):
    assert ids(search.select_matching(sample, {"to_date": "2024-01-02"})) == ["<1@x>"]
    assert ids(search.select_matching(sample, {"to_date": "2024-01-02 13:00:00"})) == ["<1@x>", "<2@x>"]
    assert ids(search.select_matching(sample, {"from_date": "2024-01-02"})) == ["<2@x>", "<3@x>"]


def test_listing_puts_undated_mail_last_and_breaks_ties(emails_of):
    day = dt.datetime(2024, 1, 1)
    emails = emails_of(
        {"message_id": "b", "date": day}, {"message_id": "a", "date": day},
        {"message_id": "n", "date": None}, {"message_id": "z", "date": dt.datetime(2025, 1, 1)},
    )
    assert ids(search.list_emails(emails)) == ["z", "a", "b", "n"]
    assert ids(search.list_emails(emails, {"limit": 2, "offset": 1})) == ["a", "b"]
    assert ids(search.list_emails(emails, {"limit": 2})) == ["z"]
    assert ids(search.list_emails(emails, {"limit": 9, "offset": 9})) == []


def test_sent_and_ids(sample, emails_of, spark):
    sent = emails_of({"message_id": "s", "labels": ["Sent"]}, {"message_id": "t", "labels": [""]})
    assert ids(search.list_emails(sent, {"limit": 5, "offset": 0}, sent=True)) == ["s"]
    wanted = spark.createDataFrame([("<2@x>",), ("<2@x>",), ("none",)], "message_id string")
    assert ids(search.restrict_to_ids(sample, wanted)) == ["<2@x>"]


def test_lookup(sample):
    assert ids(search.point_lookup(sample, "<2@x>")) == ["<2@x>"]
    assert ids(search.point_lookup(sample, "missing")) == []


def test_counts(sample, emails_of):
    assert search.count_matching(sample).first()["email_count"] == 3
    assert search.count_matching(sample.limit(0)).first()["email_count"] == 0
    twice = emails_of({"message_id": "a"}, {"message_id": "a", "email_start": 5})
    assert search.count_matching(twice).first()["email_count"] == 1


@pytest.mark.parametrize("page, more, following", [(1, True, 2), (2, True, 3), (3, False, -1)])
def test_page_meta(spark, page, more, following):
    total = spark.createDataFrame([(5,)], "total_count bigint")
    row = search.page_meta(total, page, 2).first()
    assert (row["start_index"], row["has_more"], row["next_page"]) == ((page - 1) * 2, more, following)


def test_search_mail_counts_with_the_folder(emails_of):
    emails = emails_of(
        {"message_id": "1", "labels": ["Sent"]}, {"message_id": "2", "labels": ["Inbox"]},
        {"message_id": "3", "labels": ["Sent"], "subject": "Other"},
    )
    result = search_mail(emails, "subject:choir", page_size=1, folder="Sent")
    assert ids(result.page) == ["1"]
    assert result.meta.first()["total_count"] == 1
    assert search_mail(emails, None, page_size=2).meta.first()["has_more"]


@pytest.fixture
def meanings(spark):
    rows = [(f"<{n}@x>", [1.0, n / 10.0]) for n in range(1, 4)] + [("<far@x>", [-1.0, 0.0])]
    return spark.createDataFrame(rows, "message_id string, vec array<float>")


def semantic(sample, meanings, text, vector=(1.0, 0.0), **options):
    return search_mail(sample, text, vectors=meanings, embed=lambda _: vector, **options)


def test_semantic_search_orders_by_distance_and_filters(sample, meanings):
    assert ids(semantic(sample, meanings, "rag:x").page) == ["<1@x>", "<2@x>", "<3@x>"]
    found = semantic(sample, meanings, "rag:x label:inbox", page=2, page_size=1)
    assert ids(found.page) == ["<2@x>"] and found.meta.first()["total_count"] == 2


def test_slicing_first_gives_short_pages(sample, meanings):
    found = semantic(sample, meanings, "rag:x label:work", page=1, page_size=2, mode="slice_first")
    assert ids(found.page) == [] and found.meta.first()["total_count"] == 3
    found = semantic(sample, meanings, "rag:x label:work", page=2, page_size=2, mode="slice_first")
    assert ids(found.page) == ["<3@x>"]


def test_semantic_search_without_hits_or_vector_is_empty(sample, meanings):
    assert ids(semantic(sample, meanings, "rag:x", (0.0, -1.0), max_distance=0.1).page) == []
    nothing = semantic(sample, meanings, "rag:x", None)
    assert ids(nothing.page) == [] and nothing.meta.first()["total_count"] == 0


def test_search_many_gives_each_match_once(sample):
    hits = search.search_many(sample, {"a": "label:inbox", "b": "from:bob", "c": "label:none"})
    found = sorted((r["search"], r["message_id"]) for r in hits.collect())
    assert found == [("a", "<1@x>"), ("a", "<2@x>"), ("b", "<2@x>")]


def test_normalised_fills_defaults_and_keeps_rows(emails_of):
    emails = emails_of({"subject": None, "labels": None, "date": None}).drop("thread_id")
    row = search.normalised(emails).first()
    assert (row["subject"], row["labels"], row["thread_id"], row["date"]) == ("", [], "", None)
    with pytest.raises(KeyError, match="email_end"):
        search.normalised(emails.drop("email_end"))


def test_every_row_of_a_repeated_id_is_on_some_page(emails_of, spark):
    emails = emails_of(*[{"message_id": "same", "email_start": n, "email_end": n + 1} for n in range(8)])
    pages = [search_mail(emails, "subject:choir", page=n, page_size=5) for n in (1, 2)]
    assert sorted(r["email_start"] for p in pages for r in p.page.collect()) == list(range(8))
    assert [tuple(p.meta.first())[2:4] for p in pages] == [(8, True), (8, False)]
    vectors = spark.createDataFrame([("same", [1.0, 0.0]), ("no mail", [1.0, 0.0])], "message_id string, vec array<float>")
    pages = [semantic(emails, vectors, "rag:x", page=n) for n in (1, 2)]
    assert sorted(r["email_start"] for p in pages for r in p.page.collect()) == list(range(8))
    sliced = semantic(emails, vectors, "rag:x", mode="slice_first")
    assert sliced.meta.first()["total_count"] == 1 and sliced.page.count() == 8
