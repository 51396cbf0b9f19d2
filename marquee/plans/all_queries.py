"""All named queries; importing the families fills the list."""

from marquee.plans import catalog, corpora, features, models, relations, vectors  # noqa: F401
from marquee.plans.common import QUERIES, SQL  # noqa: F401
