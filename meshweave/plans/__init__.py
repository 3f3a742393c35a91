"""What is known before a job runs: file patterns, store plans."""
