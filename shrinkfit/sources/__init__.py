from .readers import (MOVIES_SCHEMA, RATINGS_SCHEMA, Quarantine, count_malformed, quarantine, read_csv, read_delimited,
                      read_parquet, write_delimited, write_parquet)
from .tables import NO_GENRE, FileInput, enrich, load_files, movielens, movielens_from_files, movies_view, ratings_view

__all__ = [
    "FileInput", "Quarantine", "load_files", "quarantine",
    "MOVIES_SCHEMA", "RATINGS_SCHEMA", "NO_GENRE", "count_malformed", "enrich", "movielens",
    "movielens_from_files", "movies_view", "ratings_view", "read_csv", "read_delimited", "read_parquet", "write_delimited",
    "write_parquet",
]
