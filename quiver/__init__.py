"""quiver: a PySpark feature, label and evaluation engine for conversion and
return-on-spend samples. See README.md.

The names below are the public API; each module documents its operators by
the survey's IDs."""

__version__ = "0.1.0"

from quiver.functions.arrays import fixed_length, masked_mean_pool, masked_softmax, self_attention_pool
from quiver.functions.labels import (binarize, binarize_reward, clip, label_weight, log_tail, positive_weight,
                                     shape_reward, shape_reward_v2)
from quiver.functions.losses import (cross_entropy, focal, huber, mae, parse_loss_names, weighted_ce,
                                     weighted_ce_logits)
from quiver.functions.segments import in_list, partition_by_level, partition_by_list, partition_level_treatment
from quiver.functions.transforms import (array_reduce, bucket_centers, bucketize, column_or_default, compress,
                                         log_ratio, signed_delta, soft_bucket, step_pair_mean)
from quiver.operators.dataset import (assign_batch, date_holdout, filter_equal, holdout_paths,
                                      path_prefix_before, repeat, shuffle_partitions, shuffle_rows)
from quiver.operators.derive import apply_log_ratios, bucket_time_deltas, horizon_deltas, time_delta_ratio
from quiver.operators.features import (bucket_encode, bucket_features_1d, bucket_features_2d, bucket_histogram,
                                       bucket_ids, bucket_target_mean, bucketize_long, classify_feature,
                                       feature_summary, hash_slot, skip_columns_containing, spec_table, to_long)
from quiver.operators.horizons import cumulative_in_day, entities_per_hour, multi_horizon, previous_value
from quiver.operators.sequence import last_k
from quiver.plans.metrics import (accuracy, accuracy_sweep, binned_auc, confusion, evaluation_report,
                                  masked_mean, mean_metrics, mse, pairwise_auc, precision, recall, recall_at,
                                  stats_by_bucket, stats_by_segment, total_loss)
from quiver.plans.prefix import running_totals, running_totals_by
from quiver.plans.quantiles import exact_quantiles, exact_quantiles_by, fit_bounds, fit_bounds_by
from quiver.plans.running import running_stats
from quiver.sources.reader import Field, check_schema, conform, read_samples, split_label
from quiver.sources.sink import sample_by_hash, scored_rows, write_scored
