"""Free flight as a Gaussian over position and velocity, moved and corrected as a whole.

With state s = (position, velocity) in the stabilised orientation, a look at the ball is the vector
z = (pixel x, pixel y, log depth). Around the predicted state its Jacobian is H, and the correction is

    K = P H' (H P H' + R)^-1,   s <- s + K (z - h(s)),   P <- (I - K H) P (I - K H)' + K R K'

where the noise R is divided by the trust in the look: a Student-like weight that falls when the size
contradicts the flight so far.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Fixed values of the flight model.
GRAVITY_MPS2 = 9.81
ACCELERATION_SIGMA = 8.0
DEPTH_SIGMA = 0.3
SIZE_TOLERANCE_SIGMAS = 1.5
MIN_DEPTH_M = 0.05
LAUNCH_SIGMAS = ((0.1, 0.1, 0.3), (2.0, 2.0, 8.0))  # of position per metre of depth, and of velocity

COLUMNS = (
    "x_m", "y_m", "z_m", "vx_mps", "vy_mps", "vz_mps",
    "stabilized_x_m", "stabilized_y_m", "stabilized_z_m",
    "stabilized_vx_mps", "stabilized_vy_mps", "stabilized_vz_mps",
)


class Look(NamedTuple):
    """A pixel with its standard deviation, and the depth if the size is trustworthy."""

    pixel: np.ndarray
    sigma_px: float
    depth_m: float | None = None


class Flight(NamedTuple):
    track: int
    time_s: float
    mean: np.ndarray
    cov: np.ndarray

    @classmethod
    def launch(cls, track: int, time_s: float, position, velocity, to_stabilised: np.ndarray) -> Flight:
        """A flight known from one look, with ``position`` and ``velocity`` in the camera's orientation."""
        both = np.stack([position, velocity]) @ to_stabilised.T
        spread = np.array(LAUNCH_SIGMAS) * [[position[2]], [1.0]]
        cov = np.zeros((6, 6))
        for k, sigma in enumerate(spread):
            own = slice(3 * k, 3 * k + 3)
            cov[own, own] = (to_stabilised * sigma**2) @ to_stabilised.T
        return cls(track, time_s, both.ravel(), cov)

    def moved(self, time_s: float, gravity: np.ndarray) -> Flight:
        """The flight at a later time, pulled by ``gravity`` and shaken by unknown acceleration."""
        dt = time_s - self.time_s
        shift = np.eye(6) + dt * np.eye(6, k=3)
        pull = np.vstack([0.5 * dt * dt * np.eye(3), dt * np.eye(3)])
        cov = shift @ self.cov @ shift.T + ACCELERATION_SIGMA**2 * pull @ pull.T
        return self._replace(time_s=time_s, mean=shift @ self.mean + pull @ gravity, cov=cov)

    def corrected(self, look: Look, to_camera: np.ndarray, intrinsics) -> Flight:
        """The flight after a look; unchanged where the ball would be at or behind the lens."""
        local = to_camera @ self.mean[:3]
        depth = local[2]
        if depth < MIN_DEPTH_M:
            return self
        focal, centre = np.array(intrinsics[:2]), np.array(intrinsics[2:])
        slope = np.column_stack([np.diag(focal) / depth, -focal * local[:2] / depth**2])
        miss = look.pixel - (focal * local[:2] / depth + centre)
        noise = np.full(2, look.sigma_px**2)
        if look.depth_m is not None:
            slope = np.vstack([slope, [0, 0, 1 / depth]])
            miss, noise = np.append(miss, np.log(look.depth_m / depth)), np.append(noise, DEPTH_SIGMA**2)
        h = np.hstack([slope @ to_camera, np.zeros((len(miss), 3))])
        seen = h @ self.cov @ h.T
        if look.depth_m is not None:
            surprise = miss[2] ** 2 / (seen[2, 2] + noise[2])
            noise = noise * (1 + surprise / SIZE_TOLERANCE_SIGMAS**2)
        gain = np.linalg.solve(seen + np.diag(noise), h @ self.cov).T
        rest = np.eye(6) - gain @ h
        cov = rest @ self.cov @ rest.T + (gain * noise) @ gain.T
        return self._replace(mean=self.mean + gain @ miss, cov=cov)

    def report(self, to_camera: np.ndarray) -> dict[str, float]:
        """Position and velocity as the camera sees them and stabilised, and the depth's deviation."""
        both = self.mean.reshape(2, 3)
        values = dict(zip(COLUMNS, np.concatenate([(both @ to_camera.T).ravel(), self.mean]), strict=True))
        axis = to_camera[2]
        values["depth_sigma_m"] = float(np.sqrt(max(axis @ self.cov[:3, :3] @ axis, 0.0)))
        return values
