"""Reading feeds and logs, writing feeds and reports."""
