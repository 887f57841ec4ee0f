"""Reading and writing call logs, change logs, table snapshots and rule artifacts."""
