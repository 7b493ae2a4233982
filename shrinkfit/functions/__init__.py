from .columns import (DIGITS_ONLY, GENRE_SEP, PAREN_GROUP, day_of_week_sunday0, epoch_to_timestamp,
                      genre_count, genre_tokens, indicator_columns, lambda_values, rating_date_parts,
                      release_year, sanitize_genre, week_of_year_monday)

__all__ = [
    "DIGITS_ONLY", "GENRE_SEP", "PAREN_GROUP", "day_of_week_sunday0", "epoch_to_timestamp",
    "genre_count", "genre_tokens", "indicator_columns", "lambda_values", "rating_date_parts",
    "release_year", "sanitize_genre", "week_of_year_monday",
]
