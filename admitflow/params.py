"""Run parameters shared by the feature, cohort and training plans."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    observation_window_hours: int = 24
    encoder_training_epochs: int = 170
    num_of_bins_for_numerics: int = 6
    negative_to_positive_ratio: float = 3.0
    test_set_fraction: float = 0.30
    validation_set_fraction: float = 0.10
    train_set_fraction: float = 0.80
    random_state: int = 11
    lab_lookback_days: int = 7
    previous_admission_days: int = 360
    max_sparsity: float = 0.95
