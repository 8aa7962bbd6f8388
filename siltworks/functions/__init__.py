"""Column functions whose results on nulls, NaN and text are fixed, whatever the session is set to."""
