"""What a city's page needs, as frames over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import listing


def city_listing(
    events: DataFrame, venues: DataFrame, city: str, now: Column, as_of: Column, **filters
) -> dict[str, DataFrame]:
    """Upcoming events under the reader's filters, the types to choose from, the count line,
    and the first venues with their total."""
    ahead = listing.upcoming(events, now, city)
    filtered = listing.apply_filters(ahead, as_of, **filters)
    return {
        "events": listing.events_by_date(filtered),
        "types": listing.available_types(ahead),
        "count": listing.result_count(filtered),
        "venues": listing.first_venues(venues.filter(F.col("city") == city)),
    }
