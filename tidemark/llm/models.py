"""Small models that are fitted on the driver: regression, calibration and a label model."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def derivatives(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted log loss; they add up over parts of the rows."""
    p = sigmoid(x @ beta)
    return x.T @ (weight * (p - y)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


def newton(slope: np.ndarray, curve: np.ndarray, beta: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Coefficients after a step with a ridge penalty, which spares the intercept, and the step's size."""
    ridge = np.full(len(beta), penalty)
    ridge[-1] = 1e-3
    step = np.linalg.solve(curve + np.diag(ridge), slope + ridge * beta)
    size = np.abs(step).max()
    return beta - (step * min(1.0, 4.0 / size) if size else 0.0), size


def logistic_regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the intercept last, for labels from 0 to 1; Newton's method with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    weight = np.ones(len(x)) if weight is None else weight
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        beta, size = newton(*derivatives(x, y, weight, beta), beta, penalty)
        if size < 1e-6:
            break
    return beta


def linear(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


def platt(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept that turn margins into log-odds."""
    return logistic_regression(margin[:, None], y, penalty=1e-2)


#: How often a label is right to begin with, and the rows that this belief counts for.
LABELS_RIGHT, BELIEF = 0.95, 20.0


class LabelModel:
    """Posterior labels from voters that say toxic (1), clean (-1) or nothing (0), and from labels that may be wrong.

    A mixture of two classes: for each voter the rates of its three answers in either class, found by expectation
    maximisation over all rows. Labels, where there are any, are one more voter, whose accuracy in either class is estimated
    as well; they begin the search, so that the classes have their meaning. Voters aren't independent: given the class, the
    correlations of their residuals are estimated, and a voter's evidence is divided by one plus the sum of its positive
    correlations with the others, so that a group of voters that move together counts about as one. With enough
    voters against it, a label is overruled.
    """

    def __init__(self, rounds: int = 20, smoothing: float = 1.0):
        self.rounds, self.smoothing = rounds, smoothing
        self.rates: np.ndarray | None = None

    def fit(self, total) -> LabelModel:
        """``total(measure)`` is the sum of ``measure(votes, label, weight)`` over all rows; labels are 1, 0 or, where unknown, -1."""
        first = np.log([[LABELS_RIGHT, 1 - LABELS_RIGHT], [1 - LABELS_RIGHT, LABELS_RIGHT]])
        self.label_rates = first
        for _ in range(self.rounds):
            last = self.rates
            self._step(total(self.sums))
            if last is not None and np.abs(np.exp(self.rates) - np.exp(last)).max() < 1e-5:
                break
        return self

    def sums(self, votes: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What a step needs of some rows: answers by class, labels by class, rows by class, residuals' products."""
        known = label >= 0
        post = np.where(label == 1, LABELS_RIGHT, 1 - LABELS_RIGHT) if self.rates is None else self.posterior(votes, label)
        both = np.stack([1 - post, post], axis=1) * weight[:, None]
        if self.rates is None:
            both *= known[:, None]  # labels alone begin
        answers = np.stack([both.T @ (votes == v) for v in (-1, 0, 1)], axis=2)
        labels = np.stack([both[label == v].sum(axis=0) for v in (0, 1)], axis=1)
        products = np.zeros((votes.shape[1],) * 2)
        if self.rates is not None:
            share = both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)
            rest = (votes - share @ (np.exp(self.rates) @ np.array([-1.0, 0.0, 1.0]))) * np.sqrt(weight)[:, None]
            products = rest.T @ rest
        return np.concatenate([answers.ravel(), labels.ravel(), both.sum(axis=0), products.ravel()])

    def _step(self, sums: np.ndarray) -> None:
        m = int((np.sqrt(36 + 4 * (len(sums) - 6)) - 6) / 2 + 0.5)  # 6 m + 4 + 2 + m^2 numbers
        answers, labels, rows, products = np.split(sums, [6 * m, 6 * m + 4, 6 * m + 6])
        counts = answers.reshape(2, m, 3)
        counts = counts + self.smoothing * counts.sum(axis=0) / max(rows.sum(), 1)
        self.rates = np.log(counts / counts.sum(axis=2, keepdims=True) + 1e-12)
        self.prior = np.log(rows / rows.sum() + 1e-9)
        right = labels.reshape(2, 2) + BELIEF * np.array([[LABELS_RIGHT, 1 - LABELS_RIGHT], [1 - LABELS_RIGHT, LABELS_RIGHT]])
        self.label_rates = np.log(right / right.sum(axis=1, keepdims=True))
        spread = np.sqrt(np.diag(products.reshape(m, m))) + 1e-9
        self.correlations = products.reshape(m, m) / np.outer(spread, spread)
        together = np.maximum(self.correlations - np.diag(np.diag(self.correlations)), 0).sum(axis=1)
        self.weights = 1 / (1 + together)

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        ratio = self.rates[1] - self.rates[0]
        evidence = ((votes < 0) @ (ratio[:, 0] * self.weights)) + ((votes == 0) @ (ratio[:, 1] * self.weights)) + ((votes > 0) @ (ratio[:, 2] * self.weights))
        said = np.where(label < 0, 0.0, (self.label_rates[1] - self.label_rates[0])[np.maximum(label, 0)])
        return sigmoid(self.prior[1] - self.prior[0] + evidence + said)

    def accuracies(self) -> np.ndarray:
        """How often each voter is right where it votes."""
        r = np.exp(self.rates + self.prior[:, None, None])
        return (r[0, :, 0] + r[1, :, 2]) / (r[:, :, 0] + r[:, :, 2]).sum(axis=0)
