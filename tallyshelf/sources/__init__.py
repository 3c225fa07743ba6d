"""Where tables come from: messy CSV exports, Parquet warehouses, scratch folders."""
