from __future__ import annotations

import pytest

from pagelens.functions.jsonschema import UnsupportedKeyword, Validator, is_date_time, is_uri
from pagelens.functions.schemas import BUILT_IN, SchemaRegistry

R = SchemaRegistry.default()


def fields(item, registry=R):
    return [(e["field"], e["type"]) for e in registry.validate(item)]


def test_registry():
    assert len(BUILT_IN) == 18
    r = SchemaRegistry({"A": {"type": "object"}})
    assert r.register("B", {"required": ["x"]}) is r and r.is_registered("B") and r.fetch("A") == {"type": "object"}
    copy = r.dup().register("C", {})
    assert not r.is_registered("C") and copy.is_registered("C") and set(r.to_dict()) == {"A", "B"}
    with pytest.raises(KeyError):
        r.fetch("Z")
    assert fields({"@type": "B"}, r) == [("", "B")]


def test_required_message():
    e = R.validate({"@type": "Article"})
    assert len(e) == 1 and "did not contain a required property of 'headline'" in e[0]["issue"]
    assert any("'reviewRating'" in x["issue"] for x in R.validate({"@type": "WebApplication", "name": "x", "review": {"@type": "Review"}}))


def test_unknown_and_untyped_items_are_valid():
    for item in ({"@type": "Thing"}, {"name": 1}, {"@type": ["Article"]}, None, "x", 3, {"nested": {"@type": "Article"}}):
        assert R.validate(item) == []


def test_graphs_and_lists():
    assert fields(["x", {"@type": "Unknown"}, {"@graph": [{"@type": "Article"}, {"@type": "WebSite"}]}]) == [("", "Article")]
    assert fields({"@type": "Article", "@graph": [{"@type": "Event"}]}) == [("", "Event"), ("", "Event"), ("", "Article")]


@pytest.mark.parametrize(("item", "expected"), [
    ({"@type": "Article", "headline": "x" * 110}, []),
    ({"@type": "Article", "headline": "x" * 111}, ["headline"]),
    ({"@type": "Article", "headline": "x", "datePublished": "2026-01-01"}, ["datePublished"]),
    ({"@type": "Article", "headline": "x", "datePublished": "2026-01-01T10:00:00Z", "author": {}}, []),
    ({"@type": "Article", "headline": "x", "author": "me", "image": "not a uri"}, ["image", "author"]),
    ({"@type": "Product", "name": "x", "image": {"@type": "ImageObject"}}, []),
    ({"@type": "Product", "name": "x", "image": ["https://a.example/i", {"@type": "ImageObject"}]}, []),
    ({"@type": "Product", "name": "x", "image": [3]}, ["image"]),
    ({"@type": "Product", "name": "x", "offers": [{"@type": "Offer", "price": "3"}]}, []),
    ({"@type": "HowTo", "name": "x", "step": []}, ["step"]),
    ({"@type": "HowTo", "name": "x", "step": [{"@type": "HowToStep", "name": "n", "text": "t", "position": 0}]}, ["step/0/position"]),
    ({"@type": "BreadcrumbList", "itemListElement": [{"@type": "ListItem", "position": "1", "name": "n", "item": "https://a.example"}]}, ["itemListElement/0/position"]),
    ({"@context": "x", "@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "q", "acceptedAnswer": {"@type": "Answer"}}]}, ["mainEntity/0/acceptedAnswer"]),
    ({"@type": "SoftwareApplication", "name": "x", "aggregateRating": {"@type": "AggregateRating", "ratingCount": 1.5}}, ["aggregateRating/ratingCount"]),
    ({"@type": "JobPosting", "title": "t", "description": "d", "datePosted": "2026-01-01", "hiringOrganization": {"@type": "Organization", "name": "o"}}, [""]),
    ({"@type": "JobPosting", "title": "t", "description": "d", "datePosted": "2026-01-01", "hiringOrganization": {"@type": "Organization", "name": "o"}, "jobLocationType": "TELECOMMUTE", "applicantLocationRequirements": [{}]}, []),
    ({"@context": "http://schema.org", "@type": "JobPosting", "title": "t", "description": "d", "datePosted": "x", "hiringOrganization": {"@type": "Organization", "name": "o"}, "jobLocation": {}, "directApply": "yes", "employmentType": []}, ["employmentType", "directApply", "@context"]),
])
def test_built_in_schemas(item, expected):
    assert [f for f, _ in fields(item)] == expected


def test_constants_only_on_request():
    item = {"@type": "Organization", "name": "x", "logo": {"@type": "Wrong", "url": "https://a.example"}}
    assert R.validate(item) == []
    assert [e["field"] for e in SchemaRegistry(BUILT_IN, enforce_const=True).validate(item)] == ["logo"]


def test_keywords():
    with pytest.raises(UnsupportedKeyword):
        Validator({"oneOf": []}).errors({})
    assert SchemaRegistry({"A": {"pattern": "x"}}).validate({"@type": "A"})[0]["field"] == "unknown"
    v = Validator({"type": ["integer", "null"], "minimum": 2, "enum": [1, 2, 3, None]})
    assert [bool(v.errors(x)) for x in (1, 2, True, None, 2.0)] == [True, False, True, False, True]


def test_formats():
    assert is_uri("https://a.example/b?c#d") and is_uri("/relative") and not is_uri("a b") and not is_uri("https://a.example/ü")
    assert is_date_time("2024-02-29T00:00:00+01:00") and not is_date_time("2023-02-29T00:00:00Z") and not is_date_time("2024-01-01T00:00:00")
