"""parleo: DataFrame operators for analysing large piles of recorded-call transcripts."""
