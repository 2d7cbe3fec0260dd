"""millrace: a DataFrame-first analytics engine for trajectory, reward and corpus data."""
