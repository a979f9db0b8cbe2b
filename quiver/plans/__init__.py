"""Plans: metrics, distributed running totals, running stats, model jobs."""
