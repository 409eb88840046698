"""claimloom: claim-to-evidence analytics as Spark table jobs."""
