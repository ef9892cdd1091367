"""Fixed queries; importing the package registers them all in ``queries.QUERIES``."""

from lociform.plans import mapping, queries, regional, regions, studies  # noqa: F401
