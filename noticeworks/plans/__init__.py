"""Jobs: whole tables in, whole tables out."""
