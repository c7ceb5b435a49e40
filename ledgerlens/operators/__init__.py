"""DataFrame -> DataFrame operators (cleaning, aggregates, RFM, forecast, KPI)."""
