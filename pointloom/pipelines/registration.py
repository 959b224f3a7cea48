"""Registration of clouds, by the names and defaults of the usual interface."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.formatting import fixed
from pointloom.functions.vec import NORMAL, has
from pointloom.geometry import PointCloud, SearchParam
from pointloom.operators import features as FE
from pointloom.operators import registration as R
from pointloom.operators.registration import Distance, EdgeLength, NormalAngle
from pointloom.operators.registration import IcpCriteria as ICPConvergenceCriteria
from pointloom.operators.registration import RansacCriteria as RANSACConvergenceCriteria
from pointloom.operators.registration import Result as RegistrationResult


class TransformationEstimation:
    plan: R.Estimation

    def compute_transformation(self, source: PointCloud, target: PointCloud, corres: DataFrame) -> np.ndarray:
        return R.transformation(source.df, target.df, corres, self.plan)

    def compute_rmse(self, source: PointCloud, target: PointCloud, corres: DataFrame) -> float:
        R.check_pairs(source.df, target.df, corres)
        if self.plan.plane and not target.has_normals():
            return 0.0
        return R.rmse(source.df, target.df, corres, self.plan).first()[0]


class TransformationEstimationPointToPoint(TransformationEstimation):
    def __init__(self, with_scaling: bool = False):
        self.with_scaling = with_scaling

    def __repr__(self) -> str:
        return f"TransformationEstimationPointToPoint(with_scaling={self.with_scaling})"

    @property
    def plan(self) -> R.Estimation:
        return R.Estimation(with_scaling=self.with_scaling)


class TransformationEstimationPointToPlane(TransformationEstimation):
    plan = R.Estimation(plane=True)

    def __repr__(self) -> str:
        return "TransformationEstimationPointToPlane"


class CorrespondenceChecker:
    """A test of correspondences, given as a table (source_id, target_id), under a transformation."""

    def passed(self, source: DataFrame, target: DataFrame, corres: DataFrame, transformation: np.ndarray) -> DataFrame:
        raise NotImplementedError

    def Check(self, source: PointCloud, target: PointCloud, corres: DataFrame, transformation) -> bool:
        R.check_pairs(source.df, target.df, corres)
        return self.passed(source.df, target.df, corres, np.asarray(transformation, float)).first()[0]

    @property
    def require_pointcloud_alignment_(self) -> bool:
        return self.require_pointcloud_alignment


@dataclass(frozen=True, repr=False)
class CorrespondenceCheckerBasedOnEdgeLength(EdgeLength, CorrespondenceChecker):
    def passed(self, source, target, corres, transformation):
        return R.edge_length_check(source, target, corres, self.similarity_threshold)

    def __repr__(self) -> str:
        return f"CorrespondenceCheckerBasedOnEdgeLength with similarity_threshold={fixed(self.similarity_threshold, 6)}"


@dataclass(frozen=True, repr=False)
class CorrespondenceCheckerBasedOnDistance(Distance, CorrespondenceChecker):
    def passed(self, source, target, corres, transformation):
        return R.distance_check(source, target, corres, self.distance_threshold, transformation)

    def __repr__(self) -> str:
        return f"CorrespondenceCheckerBasedOnDistance with distance_threshold={fixed(self.distance_threshold, 6)}"


@dataclass(frozen=True, repr=False)
class CorrespondenceCheckerBasedOnNormal(NormalAngle, CorrespondenceChecker):
    def passed(self, source, target, corres, transformation):
        if not (has(source, NORMAL) and has(target, NORMAL)):
            return source.sparkSession.range(1).select(F.lit(True).alias("passed"))
        return R.normal_check(source, target, corres, self.normal_angle_threshold, transformation)

    def __repr__(self) -> str:
        return f"CorrespondenceCheckerBasedOnNormal with normal_threshold={fixed(self.normal_angle_threshold, 6)}"


@dataclass(repr=False)
class Feature:
    """dim x num numbers, or a table (pid, feat)."""

    df: DataFrame | None = None
    data: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __repr__(self) -> str:
        return f"Feature class with dimension = {self.dimension()} and num = {self.num()}\nAccess its data via data member."

    def resize(self, dim: int, n: int) -> None:
        if dim < 0 or n < 0:
            raise ValueError("feature sizes must not be negative")
        self.df, self.data = None, np.zeros((dim, n))

    def dimension(self) -> int:
        return len(self.df.first()["feat"]) if self.df is not None else self.data.shape[0]

    def num(self) -> int:
        return self.df.count() if self.df is not None else self.data.shape[1]

    def to_numpy(self) -> np.ndarray:
        return np.array([r.feat for r in self.df.orderBy("pid").collect()]).T if self.df is not None else self.data

    def table(self, spark: SparkSession | None = None) -> DataFrame:
        if self.df is not None:
            return self.df
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.data.T)], "pid long, feat array<double>")


def compute_fpfh_feature(input: PointCloud, search_param: SearchParam) -> Feature:
    return Feature(FE.fpfh(input.df, search_param.plan()))


def correspondences_from_features(source_features: Feature, target_features: Feature, mutual_filter: bool = False, mutual_consistency_ratio: float = 0.1, spark: SparkSession | None = None) -> DataFrame:
    return FE.correspondences(source_features.table(spark), target_features.table(spark), mutual_filter, mutual_consistency_ratio)


def evaluate_registration(source: PointCloud, target: PointCloud, max_correspondence_distance: float, transformation=None) -> RegistrationResult:
    return R.evaluate(source.df, target.df, max_correspondence_distance, transformation)


def registration_icp(source: PointCloud, target: PointCloud, max_correspondence_distance: float, init=None, estimation_method: TransformationEstimation | None = None, criteria: ICPConvergenceCriteria | None = None) -> RegistrationResult:
    method = estimation_method or TransformationEstimationPointToPoint()
    return R.icp(source.df, target.df, max_correspondence_distance, init, method.plan, criteria or ICPConvergenceCriteria())


def registration_ransac_based_on_correspondence(source: PointCloud, target: PointCloud, corres: DataFrame, max_correspondence_distance: float, estimation_method: TransformationEstimation | None = None, ransac_n: int = 3, checkers: Sequence = (), criteria: RANSACConvergenceCriteria | None = None) -> RegistrationResult:
    method = estimation_method or TransformationEstimationPointToPoint()
    return R.ransac(source.df, target.df, corres, max_correspondence_distance, method.plan, ransac_n, checkers, criteria or RANSACConvergenceCriteria())


def registration_ransac_based_on_feature_matching(source: PointCloud, target: PointCloud, source_feature: Feature, target_feature: Feature, mutual_filter: bool, max_correspondence_distance: float, estimation_method: TransformationEstimation | None = None, ransac_n: int = 3, checkers: Sequence = (), criteria: RANSACConvergenceCriteria | None = None) -> RegistrationResult:
    if ransac_n < 3 or max_correspondence_distance <= 0:
        return RegistrationResult()
    spark = source.df.sparkSession
    pairs = FE.correspondences(source_feature.table(spark), target_feature.table(spark), mutual_filter, 0.1)
    return registration_ransac_based_on_correspondence(source, target, R.written(pairs, "feature-pairs"), max_correspondence_distance, estimation_method, ransac_n, checkers, criteria)


def get_information_matrix_from_point_clouds(source: PointCloud, target: PointCloud, max_correspondence_distance: float, transformation) -> np.ndarray:
    return R.information_matrix(source.df, target.df, max_correspondence_distance, transformation)
