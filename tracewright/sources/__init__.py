"""Where tables come from and go to: transcripts, ledgers, rule files."""
