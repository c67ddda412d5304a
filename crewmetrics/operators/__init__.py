"""Set-oriented operators: workforce, activity, ranking, mastery, trimmed, quality."""
