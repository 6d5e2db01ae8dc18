"""Explicit schemas of the evaluation tables."""

PROBLEMS = "problem_id long, split string, text string, image binary, answer decimal(38,10), paraphrase_of long, render_config string, answer_text string, image_path string"
SAMPLES = "model_family string, model string, seed int, condition string, temperature decimal(4,2), problem_id long, sample_idx int, completion string, n_tokens int"
TRANSCRIPTIONS = "model_family string, model string, seed int, problem_id long, sample_idx int, transcript string"
ROLLOUTS = "seed int, step int, problem_id long, attempt int, reward double, n_tokens int"
CHECKPOINTS = "model_family string, seed int, step int, pass1 double"
WEIGHTS = "seed int, phase string, param_key string, module string, digest string"
REVIEWS = "sample_id long, condition string, verdict string"
CONFIG = "run_id string, seed int, settings map<string,string>"
