"""Views, named queries and their SQL."""

from . import file_queries as file_queries  # registers its queries beside those of `queries`
