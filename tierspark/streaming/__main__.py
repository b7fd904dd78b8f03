"""``python -m tierspark.streaming``: run the log bucket aggregator."""

from tierspark.streaming.log_stream import main

main()
