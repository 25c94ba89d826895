"""Built-in page schemas and the registry that validates structured items against them."""

from __future__ import annotations

import copy
from typing import Any

from pagelens.functions.jsonschema import Validator

STRING, URI, DATE_TIME = {"type": "string"}, {"type": "string", "format": "uri"}, {"type": "string", "format": "date-time"}
OBJECT, BOOLEAN, COUNT, ORDINAL = {"type": "object"}, {"type": "boolean"}, {"type": "integer"}, {"type": "integer", "minimum": 1}


def _either(*kinds: str) -> dict:
    return {"type": list(kinds)}


def _any(*branches: dict) -> dict:
    return {"anyOf": list(branches)}


def _list(items: dict, least: int = 0) -> dict:
    return {"type": "array", **({"minItems": least} if least else {}), "items": items}


def _typed(kind: str, needs: str = "", /, **properties: dict) -> dict:
    """An object of schema type `kind` that needs @type and the named properties."""
    return {"type": "object", "required": ["@type", *needs.split()], "properties": {"@type": {"const": kind}, **properties}}


# The types, their required properties and the constraints on each property.
_VALUE = _either("string", "number")
_IMAGE = _typed("ImageObject", url=URI, contentUrl=URI, thumbnail=_either("string", "object"))
_OFFER = _typed(
    "Offer", name=_either("string", "null"), price=_VALUE, priceCurrency=_either("string", "null"), priceSpecification=_either("object", "null"),
    availability=STRING, shippingDetails=OBJECT, hasMerchantReturnPolicy=BOOLEAN, merchantReturnPolicy=OBJECT, url=URI, eligibleQuantity=OBJECT,
    additionalProperty=_list(OBJECT),
)
_RATING = _typed("Rating", "ratingValue", ratingValue=_VALUE, bestRating=_VALUE, worstRating=_VALUE)
_AGGREGATE = _typed("AggregateRating", ratingValue=_VALUE, ratingCount=COUNT, reviewCount=COUNT, bestRating=_VALUE, worstRating=_VALUE)
_AUTHOR = _either("object", "string")
_SNIPPET = _typed("Review", "reviewRating", reviewRating=_RATING, author=_AUTHOR, reviewBody=STRING, datePublished=DATE_TIME)
_OFFERS = _any(_OFFER, _list(_OFFER))
_ONE_OR_MORE = _any(OBJECT, _list(OBJECT, 1))
_SOFTWARE = {"applicationCategory": STRING, "description": STRING, "offers": _OFFERS, "featureList": _either("string", "array"), "aggregateRating": _AGGREGATE, "review": _SNIPPET}
_ARTICLE = {
    "type": "object",
    "required": ["@type", "headline"],
    "properties": {
        "@type": {"enum": ["Article", "NewsArticle", "BlogPosting"]}, "headline": {"type": "string", "maxLength": 110}, "image": URI,
        "datePublished": DATE_TIME, "dateModified": DATE_TIME, "author": OBJECT, "publisher": OBJECT,
    },
}
_FAQ = {
    "type": "object",
    "required": ["@context", "@type", "mainEntity"],
    "properties": {"@context": {"const": "https://schema.org"}, "@type": {"const": "FAQPage"}, "mainEntity": _list({"$ref": "#/definitions/Question"}, 1)},
    "definitions": {
        "Question": _typed("Question", "name acceptedAnswer", name=STRING, acceptedAnswer={"$ref": "#/definitions/Answer"}),
        "Answer": _typed("Answer", "text", text=STRING),
    },
}
_JOB = _typed(
    "JobPosting", "title description datePosted hiringOrganization", title=STRING, description=STRING, identifier=OBJECT, datePosted=STRING,
    validThrough=STRING, employmentType=_any(STRING, _list(STRING, 1)), directApply=BOOLEAN,
    hiringOrganization=_typed("Organization", "name", name=STRING, sameAs=URI, logo=URI),
    applicantLocationRequirements=_ONE_OR_MORE, jobLocationType=STRING, jobLocation=_ONE_OR_MORE, baseSalary=OBJECT,
)
_JOB["properties"]["@context"] = {"enum": ["https://schema.org", "https://schema.org/"]}
_JOB["anyOf"] = [{"required": ["jobLocation"]}, {"required": ["jobLocationType", "applicantLocationRequirements"]}]

BUILT_IN: dict[str, dict] = {
    "FAQPage": _FAQ,
    "Article": _ARTICLE,
    "NewsArticle": _ARTICLE,
    "BlogPosting": _ARTICLE,
    "Organization": _typed("Organization", "name", name=STRING, url=URI, logo=_any(URI, _typed("ImageObject", "url", url=URI)), description=STRING),
    "SoftwareApplication": _typed("SoftwareApplication", "name", name=STRING, **_SOFTWARE),
    "WebApplication": _typed("WebApplication", "name", name=STRING, operatingSystem=STRING, url=URI, **_SOFTWARE),
    "HowTo": _typed("HowTo", "name step", name=STRING, description=STRING, step=_list(_typed("HowToStep", "name text", name=STRING, text=STRING, position=ORDINAL), 1)),
    "ContactPage": _typed("ContactPage", "name", name=STRING, description=STRING, url=URI),
    "Product": _typed("Product", "name", name=STRING, image=_any(URI, _IMAGE, _list(_any(URI, _IMAGE))), description=STRING, offers=_OFFERS),
    "Review": _typed("Review", "itemReviewed", itemReviewed=OBJECT, reviewRating=_RATING, author=_AUTHOR, datePublished=DATE_TIME, reviewBody=STRING),
    "WebSite": _typed("WebSite", name=STRING, url=URI, potentialAction=OBJECT),
    "BreadcrumbList": _typed("BreadcrumbList", "itemListElement", itemListElement=_list(_typed("ListItem", "position name item", position=ORDINAL, name=STRING, item=URI), 1)),
    "Recipe": _typed("Recipe", "name", name=STRING, image=_either("string", "array"), recipeIngredient=_list(STRING), recipeInstructions=_either("string", "array")),
    "Event": _typed("Event", "name startDate", name=STRING, startDate=DATE_TIME, endDate=DATE_TIME, location=OBJECT),
    "VideoObject": _typed("VideoObject", "name description", name=STRING, description=STRING, thumbnailUrl=URI, uploadDate=DATE_TIME),
    "WebPage": _typed("WebPage"),
    "JobPosting": _JOB,
}


class SchemaRegistry:
    """Schemas by type name. validate() gives [{field, issue, type}] for a parsed item."""

    def __init__(self, schemas: dict[str, dict] | None = None, enforce_const: bool = False):
        self._schemas = dict(schemas or {})
        self.enforce_const = enforce_const

    @classmethod
    def default(cls) -> SchemaRegistry:
        return cls(BUILT_IN)

    def fetch(self, name: str) -> dict:
        return self._schemas[name]

    def register(self, name: str, schema: dict) -> SchemaRegistry:
        self._schemas[name] = schema
        return self

    def is_registered(self, name: str) -> bool:
        return name in self._schemas

    def dup(self) -> SchemaRegistry:
        return SchemaRegistry(copy.deepcopy(self._schemas), self.enforce_const)

    def to_dict(self) -> dict[str, dict]:
        return dict(self._schemas)

    def validate(self, item: Any) -> list[dict[str, str]]:
        """Arrays give the errors of their items; an object those of its @graph, then its own.
        Types that aren't registered, or given as a list, are valid."""
        if isinstance(item, list):
            return [e for one in item for e in self.validate(one)]
        if not isinstance(item, dict):
            return []
        graph = item.get("@graph")
        found = [e for one in graph for e in self.validate(one)] if isinstance(graph, list) else []
        kind = item.get("@type")
        if not isinstance(kind, str) or kind not in self._schemas:
            return found
        try:
            errors = Validator(self._schemas[kind], self.enforce_const).errors(item)
        except (KeyError, TypeError, ValueError) as e:
            return [*found, {"field": "unknown", "issue": str(e), "type": kind}]
        return [*found, *({"field": at.replace("#/", "", 1), "issue": message, "type": kind} for at, message in errors)]
