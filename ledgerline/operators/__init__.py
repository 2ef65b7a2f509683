"""Jobs on whole tables: each takes DataFrames and returns DataFrames."""
