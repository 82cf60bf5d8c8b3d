"""Registry of named jobs: ``name -> job(air) -> DataFrame``.

Jobs take an :class:`~layover.sources.adapter.Airline`; their parameters
have fixture defaults and can be bound with ``functools.partial``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from layover.plans import accounts, bookings, fleet, hierarchical, posterior, quality, retention, survival

Job = Callable[..., DataFrame]

JOBS: dict[str, Job] = {
    # A. fleet and route exploration
    "aircraft_usage": fleet.aircraft_usage,
    "flight_no_aircraft_types": fleet.flight_no_aircraft_types,
    "airport_pair_flight_nos": fleet.airport_pair_flight_nos,
    "route_flight_nos": fleet.route_flight_nos,
    "route_flight_no_histogram": fleet.route_flight_no_histogram,
    "aircraft_range_usage": fleet.aircraft_range_usage,
    "route_model_usage": fleet.route_model_usage,
    "route_range_spread": fleet.route_range_spread,
    "route_flight_count_spread": fleet.route_flight_count_spread,
    "route_range_spread_grouped": fleet.route_range_spread_grouped,
    "flights_with_airports": fleet.flights_with_airports,
    # B. flight-time data quality
    "flight_length_ntiles": quality.flight_length_ntiles,
    "negative_duration_routes": quality.negative_duration_routes,
    "arrival_delay_histogram": quality.arrival_delay_histogram,
    "negative_duration_status": quality.negative_duration_status,
    "negative_duration_deltas": quality.negative_duration_deltas,
    "swapped_time_flights": quality.swapped_time_flights,
    "route_error_proportion": quality.route_error_proportion,
    "route_durations": quality.route_durations,
    "duration_ratio": quality.duration_ratio,
    "duration_ratio_histogram": quality.duration_ratio_histogram,
    "route_duration_histogram": quality.route_duration_histogram,
    # C. account, passenger and boarding integrity
    "frequent_flyer_accounts": accounts.frequent_flyer_accounts,
    "account_passenger_names": accounts.account_passenger_names,
    "account_flight_counts": accounts.account_flight_counts,
    "account_distinct_names": accounts.account_distinct_names,
    "account_top_passenger": accounts.account_top_passenger,
    "account_top_passenger_is_holder": accounts.account_top_passenger_is_holder,
    "passengers_per_booking": accounts.passengers_per_booking,
    "booking_count_comparison": accounts.booking_count_comparison,
    "passenger_boarding": accounts.passenger_boarding,
    "passenger_legs": accounts.passenger_legs,
    "passenger_id_coverage": accounts.passenger_id_coverage,
    "passenger_boarding_counts": accounts.passenger_boarding_counts,
    "passengers_without_boarding": accounts.passengers_without_boarding,
    "passengers_without_boarding_detail": accounts.passengers_without_boarding_detail,
    "boarding_leg_passenger_sample": accounts.boarding_leg_passenger_sample,
    "boarding_legs": accounts.boarding_legs,
    "passenger_leg_boarding": accounts.passenger_leg_boarding,
    "boarding_coverage": accounts.boarding_coverage,
    "account_boarding_drilldown": accounts.account_boarding_drilldown,
    "account_flight_drilldown": accounts.account_flight_drilldown,
    "slice_flight_drilldown": accounts.slice_flight_drilldown,
    "booking_leg_ts_agreement": accounts.booking_leg_ts_agreement,
    # D. booking behaviour
    "booking_lead_days": bookings.booking_lead_days,
    "booking_lead_days_export": bookings.booking_lead_days_export,
    "account_lead_days": bookings.account_lead_days,
    "bookings_per_day": bookings.bookings_per_day,
    "lead_days_before_after": bookings.lead_days_before_after,
    "missed_connections": bookings.missed_connections,
    "delayed_flight_customers": bookings.delayed_flight_customers,
    "lead_days_histogram": bookings.lead_days_histogram,
    "hours_to_next_histogram": bookings.hours_to_next_histogram,
    # E. retention features
    "trips": retention.trips,
    "account_booking_rates": retention.account_booking_rates,
    "booking_rate_summary": retention.booking_rate_summary,
    "time_to_next_by_ordinal": retention.time_to_next_by_ordinal,
    "time_to_next_pairs": retention.time_to_next_pairs,
    "last_flight_by_account": retention.last_flight_by_account,
    "time_to_next_flight": retention.time_to_next_flight,
    "time_to_next_flight_2": retention.time_to_next_flight_2,
    "censored_accounts": retention.censored_accounts,
    "non_censored_flights": retention.non_censored_flights,
    "survival_table": retention.survival_table,
    "survival_table_ctas": retention.survival_table_ctas,
    # F. survival and booking-rate estimation
    "mean_days_to_next": survival.mean_days_to_next,
    "rate_posterior": survival.rate_posterior,
    "rate_posterior_by_missed": survival.rate_posterior_by_missed,
    "rate_interval": survival.rate_interval,
    "mean_time_to_next": survival.mean_time_to_next,
    "survival_at_horizon": survival.survival_at_horizon,
    "time_quantile": survival.time_quantile,
    "account_flights_by_missed": survival.account_flights_by_missed,
    "missed_accounts": survival.missed_accounts,
    "account_index": survival.account_index,
    "account_sample": survival.account_sample,
    "stratum_sufficient_stats": survival.stratum_sufficient_stats,
    "account_rate_shrinkage": survival.account_rate_shrinkage,
    "stratified_rate_ratio": survival.stratified_rate_ratio,
    "rate_ratio_interval": survival.rate_ratio_interval,
    "hierarchical_rate_fit": hierarchical.hierarchical_rate_fit,
    "account_hierarchical_rates": hierarchical.account_hierarchical_rates,
    "rate_deciles": survival.rate_deciles,
    "calibration_summary": survival.calibration_summary,
    "posterior_histogram": survival.posterior_histogram,
    "account_rate_interval": posterior.account_rate_interval,
    "account_calibration": posterior.account_calibration,
    "account_calibration_histogram": posterior.account_calibration_histogram,
    "shrunk_rate_breaks": posterior.shrunk_rate_breaks,
    "implied_days_histogram": posterior.implied_days_histogram,
    "account_implied_days_histogram": posterior.account_implied_days_histogram,
}


def oracle() -> dict[str, str]:
    from layover.oracle import exploration, hierarchical, integrity, posterior, retention, survival

    out: dict[str, str] = {}
    for mod in (exploration, integrity, retention, survival, posterior, hierarchical):
        out.update(mod.ORACLE)
    return out
