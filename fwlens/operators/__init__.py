"""DataFrame operators: cleaning, detection, correlation, features, rankings, investigation."""
