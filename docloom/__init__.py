"""docloom: JSON documents at table scale, queried and edited with Spark."""
