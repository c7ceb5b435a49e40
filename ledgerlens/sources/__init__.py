from ledgerlens.sources.tables import read_table, sales_from_star, raw_sales_from_star  # noqa: F401
from ledgerlens.sources.files import (  # noqa: F401
    read_sales_csv, read_sales_parquet, write_clean, write_report,
)
